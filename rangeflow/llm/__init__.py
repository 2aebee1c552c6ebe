"""Training-data operators on documents and conversations.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames; Python runs only
inside Arrow-batched tasks on column buffers.
"""
