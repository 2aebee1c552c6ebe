"""Names and text as column expressions (TXT1 to TXT11)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that stand for a quote mark, and spaces that are not plain ones.
QUOTE_CHARS = "[\u2018\u2019\u201a\u201b\u2032\u00b4`\u201c\u201d\u201e\u2033\"]"
ODD_SPACES = "[\u00a0\u2000-\u200b\u202f\u205f\u3000]"
#: Words before an infraspecific epithet, each with the spelling it is compared under.
RANK_SPELLINGS = {
    "subsp.": "subsp.", "subsp": "subsp.", "ssp.": "subsp.", "ssp": "subsp.",
    "var.": "var.", "var": "var.",
    "f.": "f.", "fo.": "f.", "fo": "f.", "forma": "f.",
}
#: Words of a citation that look like epithets, and words a search ignores.
CITATION_WORDS = ("ex", "et", "al.", "in")
SEARCH_NOISE = ("sp", "spp", "cf", "aff", "var", "subsp", "ssp", "f", "forma")
#: Accents that a region key drops.
ACCENTED, PLAIN = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"
HYBRID = "×"
_CODE = " sp[.] '"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def regular_name(name: Column | str) -> Column:
    """TXT1: one kind of quote and space; ``Genus sp-CODE`` as ``Genus sp. 'CODE'``; open quotes closed."""
    x = F.regexp_replace(_col(name), ODD_SPACES, " ")
    x = F.regexp_replace(x, QUOTE_CHARS, "'")
    x = F.regexp_replace(x, "'{2,}", "'")
    x = F.regexp_replace(F.regexp_replace(x, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""), "\\s+", " ")
    x = F.regexp_replace(x, " '?sp[-. ]+([^' ]+)'?$", " sp. '$1'")
    return F.regexp_replace(x, "( sp[.] '[^']*)$", "$1'")


def regular_ranks(name: Column | str) -> Column:
    """TXT2: rank words from the third word on, but the last, in one spelling; nothing from a quoted word on."""
    spelling = F.create_map(*[F.lit(x) for pair in RANK_SPELLINGS.items() for x in pair])

    def words(w: Column) -> Column:
        quoted = F.filter(F.transform(w, lambda x, i: F.when((i >= 2) & x.contains("'"), i)), lambda i: i.isNotNull())
        stop = F.least(F.size(w) - 1, F.coalesce(F.get(quoted, F.lit(0)), F.size(w)))
        return F.array_join(F.transform(w, lambda x, i: F.when((i >= 2) & (i < stop), F.coalesce(F.try_element_at(spelling, x), x)).otherwise(x)), " ")

    return bind(_col(name), lambda v: F.when(v.isNotNull(), bind(F.split(v, " "), words)))


def strip_authors(name: Column | str) -> Column:
    """TXT3: a plain binomial cut at the first word that is no part of the name; codes and digits untouched."""
    x = _col(name)
    epithet = "^\\p{Ll}[\\p{Ll}-]*$"

    def fold(w: Column) -> Column:
        last = F.size(w)

        def step(state: Column, i: Column) -> Column:
            word = w[i - 1]
            rank = word.isin(*RANK_SPELLINGS) & (i < last)
            plain = (word.rlike(epithet) & ~word.isin(*CITATION_WORDS)) | (word == F.lit(HYBRID))
            idle = state["done"] | (i < state["next"])
            return F.struct(
                F.when(idle, state["keep"]).when(rank, i + 1).when(plain, i).otherwise(state["keep"]).alias("keep"),
                F.when(idle, state["next"]).when(rank, i + 2).otherwise(i + 1).alias("next"),
                F.when(idle, state["done"]).otherwise(~(rank | plain)).alias("done"),
            )

        first = F.struct(F.lit(2).alias("keep"), F.lit(3).alias("next"), F.lit(False).alias("done"))
        cut = F.aggregate(F.sequence(F.lit(3), last), first, step, lambda s: F.array_join(F.slice(w, 1, s["keep"]), " "))
        return F.when((last >= 3) & w[1].rlike(epithet), cut)

    def cut(v: Column) -> Column:
        whole = v.rlike(_CODE) | v.rlike("[0-9]")
        return F.when(whole, v).otherwise(F.coalesce(bind(F.split(v, " "), fold), v))

    return bind(x, cut)


def name_key(name: Column | str) -> Column:
    """TXT4: the key under which two names are one taxon."""
    x = regular_ranks(strip_authors(regular_name(name)))

    def key(v: Column) -> Column:
        pattern = "^(.*) sp[.] '([^']*)'$"
        code = F.regexp_replace(F.regexp_extract(v, pattern, 2), "[ _-]+", "-")
        return F.lower(F.when(v.rlike(pattern), F.concat(F.regexp_extract(v, pattern, 1), F.lit(" sp. '"), code, F.lit("'"))).otherwise(v))

    return bind(x, key)


def taxon_genus(name: Column | str) -> Column:
    """TXT5: the first word where it looks like a genus, else null."""
    genus = F.regexp_extract(_col(name), "^([A-Z][a-z-]+)(?: |$)", 1)
    return F.when(genus != "", genus)


def is_provisional_name(name: Column | str) -> Column:
    """TXT6: whether the name carries a code in quotes."""
    return regular_name(name).rlike(_CODE)


def search_key(text: Column | str) -> Column:
    """TXT7: lower-case letters and digits, without rank words."""
    words = F.split(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*SEARCH_NOISE)), " ")


def region_key(text: Column | str) -> Column:
    """TXT8: lower-case, without accents and punctuation; empty for null."""
    x = F.translate(F.coalesce(_col(text), F.lit("")), ACCENTED, PLAIN)
    return F.trim(F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")))


#: Prefixes of record references by source.
REF_PREFIX = {"iNaturalist": "inat", "MO Observations": "mo"}


def record_key(source: Column | str, number: Column | str) -> Column:
    """TXT9: ``source:number``; null where either is null."""
    return F.concat(F.trim(_col(source)), F.lit(":"), F.trim(_col(number).cast("string")))


def record_ref(source: Column | str, number: Column | str) -> Column:
    """TXT9: the short reference of a record whose source has one (``inat:N``, ``mo:N``)."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for p in REF_PREFIX.items() for x in p]), _col(source))
    return F.concat(prefix, F.lit(":"), _col(number).cast("string"))


def slug(text: Column | str, separator: str = "-") -> Column:
    """TXT10: lower-case letters and digits with one separator between runs of anything else."""
    x = F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", separator)
    edge = re.escape(separator)
    return F.regexp_replace(x, f"^({edge})+|({edge})+$", "")


def species_label(band: Column | str) -> Column:
    """TXT10: a tree band's label: ``host_acer_rubrum`` as ``Acer rubrum``."""
    x = F.regexp_replace(F.regexp_replace(_col(band), "^host_", ""), "_", " ")
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))


def rename_numbered(df: DataFrame, pattern: str, prefix: str) -> DataFrame:
    """TXT11: columns whose names match are renamed by the number in the name, not by their place."""
    found = {c: re.search(pattern, c) for c in df.columns}
    return df.withColumnsRenamed({c: f"{prefix}{int(m.group(1))}" for c, m in found.items() if m})


def arm_label(learner: Column | str, effort: Column | str) -> Column:
    """TXT11: an arm's label: the learner, and how it treats effort where it is not the default."""
    return F.when(_col(effort).isNull() | (_col(effort) == "none"), _col(learner)).otherwise(F.concat_ws(":", _col(learner), _col(effort)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
