"""Personal data by fixed formats, and by lexical patterns bootstrapped from them.

Emails, addresses, cards and phones that match their format are the seeds.  The words around seeds, and around other
identifier-like strings, are lexical patterns; Spark scores the graph of patterns and instances in rounds: a pattern is as
sure as the mean score of the different instances it meets, an instance becomes as sure as its sure patterns make it.  Sure
instances are seeds of the next round, until a round finds none; strings that could be of a pattern's kind and are not sure yet
are unknown to it, others count as misses.  Identifiers of sure patterns, of a plausible shape for the pattern's kind, are
added to the seeds' spans.

Secrets have no fixed format: long strings of letters and digits of high entropy are their seeds, but not yet spans.  They become spans when a
sure pattern names them, that is when enough different ones stand beside the same words; so do shorter strings beside those words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.rows import OWN, own, with_text_columns
from rangeflow.llm.store import Scratch
from rangeflow.llm.text import text_pieces

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds whose format alone makes a span, and the number of secrets.
FORMATS, SECRET = 4, 4
#: A secret's seed: characters and bits of entropy a character at least; and characters of any secret.
SEED_LENGTH, SEED_ENTROPY, SECRET_LENGTH = 20, 3.0, 10
#: A pattern counts with this many different seeds and this mean score; an instance with this score.
MIN_SEEDS, SURE_PATTERN, SURE_INSTANCE = 5, 0.7, 0.8
#: Discovered spans are broadcast to the texts up to this many rows and spans in all, and joined by a shuffle beyond.
BROADCAST_SPANS = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LIKE = (
    re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){5,}(?![A-Za-z0-9])"),
    re.compile(r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*"),
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9.-]+"),
)
_WORD = re.compile(r"[^\W\d_]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the formats' matches, in code points, sorted."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # the run of local characters left of the sign, as far as the last match lets it reach
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _likely(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings apart from the spans taken."""
    busy = bytearray(len(text))
    for a, _, b in taken:
        busy[a:b] = b"\1" * (b - a)
    out = []
    for k, like in enumerate(_LIKE):
        for m in like.finditer(text):
            s = m.group()
            digits = sum(c in "0123456789" for c in s)
            if (k == 0 and digits < 6) or (k == 1 and (digits < 4 or digits == len(s))):
                continue
            if busy.find(1, m.start(), m.end()) >= 0:
                continue
            busy[m.start() : m.end()] = b"\1" * len(s)
            out.append((m.start(), m.end()))
    return out


def _secret_like(s: str) -> bool:
    """Long, of letters and digits mixed, and as varied as chance would make it."""
    digits = sum(c in "0123456789" for c in s)
    if len(s) < SEED_LENGTH or digits < 4 or sum(c.isalpha() for c in s) < 4:
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= SEED_ENTROPY


def _shape(s: str) -> str:
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    return ("at" if "at)" in s or "at]" in s or "@" in s else "x" if letters else "d") + str(digits)


class _Context:
    """The words of a text, found once, and the lexical patterns of its mentions."""

    def __init__(self, text: str):
        words = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]
        self.start, self.end, self.word = ([w[k] for w in words] for k in range(3))

    def patterns(self, a: int, b: int) -> list[str]:
        """The whole word or two before a mention, however far, and the whole word after it."""
        k, j = bisect_right(self.end, a), bisect_left(self.start, b)
        out = []
        if k:
            out.append("l " + self.word[k - 1])
        if k > 1:
            out.append("l " + self.word[k - 2] + " " + self.word[k - 1])
        if j < len(self.word):
            out.append("r " + self.word[j])
        return out


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_MENTION = "array<struct<start:int,end:int,kind:int,shape:string,surface:string,patterns:array<string>>>"
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_ARROW_MENTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("shape", pa.string()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _hinted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold a digit, or a sign of an address."""
    hint = np.zeros(256, dtype=bool)
    hint[0x30:0x3A] = hint[0x40] = True
    hint[[0x28, 0x5B]] = True
    at = np.flatnonzero(hint[data])
    return np.flatnonzero(np.diff(np.searchsorted(at, offsets)) > 0)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of (id, text): a row key, the formats' spans, and all mentions with their patterns (kind -1: of no format; a secret's seed has its kind, and no span yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            spans: list = [[]] * len(batch)
            mentions: list = [[]] * len(batch)
            for a, _, data, offsets in text_pieces(batch.column(1)):
                for k in _hinted(data, offsets).tolist():
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    spans[a + k] = [{"start": s, "kind": kind, "end": e} for s, kind, e in base]
                    every = [(s, e, kind) for s, kind, e in base] + [(s, e, SECRET if _secret_like(text[s:e]) else -1) for s, e in _likely(text, base)]
                    if every:
                        near = _Context(text)
                        mentions[a + k] = [
                            {"start": s, "end": e, "kind": kind, "shape": _shape(text[s:e]), "surface": text[s:e], "patterns": near.patterns(s, e)} for s, e, kind in every
                        ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(batch))), batch.column(0), batch.column(2), pa.array(spans, _ARROW_SPAN), pa.array(mentions, _ARROW_MENTION)],
                names=["row", "id", "digest", "base", "mentions"],
            )
            row += len(batch)

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, f"row long, id {kind}, digest long, base {_SPAN}, mentions {_MENTION}")


#: Digits that an instance of a kind can have: those of the kind's format, and local phone numbers of seven and more.
_DIGITS = {"email": (0, 1 << 30), "ip": (4, 12), "card": (12, 19), "phone": (7, 15)}


def discover(scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, id, digest, start, kind, end) of identifiers that only sure patterns find."""
    mention = scanned.select("row", "id", "digest", F.explode("mentions").alias("m")).select("row", "id", "digest", "m.*")
    mention = scratch.write(mention, "mentions")
    edges = mention.select("surface", "shape", "kind", F.explode("patterns").alias("pattern"))
    edges = scratch.write(edges.groupBy("pattern", "surface", "kind").agg(F.first("shape").alias("shape")), "edges")
    digits = F.regexp_extract("shape", "([0-9]+)$", 1).cast("int")
    could = [digits.between(*_DIGITS[k]) & (F.col("shape").startswith("at") if k == "email" else F.col("shape").startswith("d")) for k in KINDS[:FORMATS]]
    could.append(F.col("shape").startswith("x") & (F.length("surface") >= SECRET_LENGTH))
    found_by = (F.col("kind") < 0) | (F.col("kind") >= FORMATS)  # what only patterns can make a span
    accepted, k = None, 0  # sure instances without a format: (surface, guess, score, whether it was a seed)
    while True:
        known = edges.select("*", F.when(F.col("kind") >= 0, F.col("kind")).alias("guess"), F.when(F.col("kind") >= 0, 1.0).alias("score"))
        if accepted is not None:
            open_ = known.where("kind < 0").drop("guess", "score").join(accepted.where("not seeded"), "surface", "left").select(*known.columns)
            known = known.where("kind >= 0").unionByName(open_)
        counts = [F.count("guess").alias("met")]
        for n, fits in enumerate(could):
            own = F.col("guess") == n
            counts += [F.count_if(own).alias(f"seeds{n}"), F.coalesce(F.sum(F.when(own, F.col("score"))), F.lit(0.0)).alias(f"weight{n}"), F.count_if(F.col("guess").isNull() & ~fits).alias(f"misses{n}")]
        kinds = [F.struct(F.col(f"weight{n}").alias("weight"), F.lit(n).alias("guess"), F.col(f"seeds{n}").alias("seeds"), (F.col("met") + F.col(f"misses{n}")).alias("met")) for n in range(len(KINDS))]
        ranked = known.groupBy("pattern").agg(*counts).select("pattern", F.array_max(F.array(*kinds)).alias("b"))
        ranked = ranked.where(f"b.seeds >= {MIN_SEEDS}").select("pattern", "b.guess", (F.col("b.weight") / F.col("b.met")).alias("sure"))
        sure = scratch.write(ranked.where(F.col("sure") >= SURE_PATTERN), f"sure{k}")
        fits = F.lit(False)
        for n, ok in enumerate(could):
            fits = fits | ((F.col("guess") == n) & ok)
        met = edges.where(found_by).join(sure, "pattern").where(fits & ((F.col("kind") < 0) | (F.col("kind") == F.col("guess"))))
        if accepted is not None:
            met = met.join(accepted.select("surface"), "surface", "left_anti")
        votes = met.groupBy("surface", "guess").agg(F.max(F.col("kind") >= FORMATS).alias("seeded"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-6)))))).alias("score"))
        best = votes.groupBy("surface").agg(F.max_by(F.struct("guess", "score", "seeded"), F.struct("score", "guess")).alias("b"))
        new = scratch.write(best.select("surface", "b.guess", "b.score", "b.seeded").where(F.col("score") >= SURE_INSTANCE), f"new{k}")
        # what is sure stays sure, so each round but the last adds one at least and the rounds end
        if accepted is not None and new.isEmpty():
            break
        accepted = new if accepted is None else scratch.write(accepted.unionByName(new), f"accepted{k}")
        if accepted.isEmpty():
            break
        k += 1
    found = mention.where(found_by).join(accepted, "surface")
    return found.select("row", "id", "digest", "start", F.col("guess").alias("kind"), "end")


def _listed(spans, names) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end by start, kind as listed, then end).

    Null text counts as empty.  Repeated rows each have their row; an empty table gives none; other columns are left out.  Kinds
    may overlap; discovered spans never overlap a base one.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = scratch.write(scan(base), "scanned")
    more = discover(scanned, scratch).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = scanned.select("row", "id", "base").join(more, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS[:FORMATS])]
    return joined.select(
        F.col("id").alias(id_col), *counts, F.sha2(_listed(F.array_sort("base"), names), 256).alias("base_sha256"), _listed(every, names).alias("spans")
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; other columns, and texts without spans, as they are.

    Overlapping spans become one, of the first one's kind.  Null text stays null; repeated rows are redacted alike; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.write(scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "scanned")
    found = discover(scanned, scratch).select("digest", "start", "kind", "end").distinct()
    found = scratch.write(found.groupBy("digest").agg(F.collect_set(F.struct("start", "kind", "end")).alias(OWN + "more")).withColumnRenamed("digest", OWN + "digest"), "found")
    n, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size(OWN + "more")), F.lit(0))).first()
    keyed = docs
    if n:
        side = F.broadcast(found) if spans <= BROADCAST_SPANS else found
        keyed = docs.withColumn(OWN + "digest", F.xxhash64(text_col)).join(side, OWN + "digest", "left").drop(OWN + "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            changed: dict[int, str] = {}
            extra = batch.column(1) if batch.num_columns > 1 else None
            for a, _, data, offsets in text_pieces(batch.column(0)):
                for k in _hinted(data, offsets).tolist():
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
                    spans = base_spans(text)
                    if extra is not None and extra[a + k].is_valid:
                        spans = sorted([*spans, *[(s["start"], s["kind"], s["end"]) for s in extra[a + k].as_py()]])
                    if spans:
                        changed[a + k] = _replace(text, spans)
            if changed:
                at = np.zeros(len(batch), dtype=bool)
                at[list(changed)] = True
                rows = sorted(changed)
                text_column = batch.column(0).cast(pa.string())
                yield [pa.compute.replace_with_mask(text_column, pa.array(at), pa.array([changed[k] for k in rows], pa.string()))]
            else:
                yield [batch.column(0).cast(pa.string())]

    out = with_text_columns(keyed, "text string", run, [text_col, *([OWN + "more"] if n else [])])
    return out.withColumn(text_col, own("text")).select(*docs.columns)


def _replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for a, kind, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, kind, b])
    for a, kind, b in merged:
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join([*out, text[at:]])
