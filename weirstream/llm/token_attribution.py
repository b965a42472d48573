"""Token counts of fields and sections from one encoding of the whole document.

The fields of a row are joined by a separator and encoded once. Token character spans are then
interval-joined to the spans of the sections; a token that crosses a boundary goes to one section by an
explicit rule, so the counts of all sections add up to the count of the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstream.llm.bpe_codec import CACHE_WORDS, LONG, BytePairTable, table_of
from weirstream.llm.common import broadcast_file, output_schema, slices, tokenizer_path, with_columns

#: Who gets a boundary-crossing token: the section of its first character, of its last one, or that
#: which holds most of its characters (the earlier one in a tie).
RULES = ("first", "last", "most")


def token_spans(tables: BytePairTable, piece: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token of a piece; a token of part of a character spans it."""
    char_of_byte = np.repeat(np.arange(len(piece)), [len(c.encode()) for c in piece])
    ends = np.cumsum([len(tables.token_bytes[i]) for i in ids])
    begins = np.r_[0, ends[:-1]]
    return char_of_byte[begins], char_of_byte[ends - 1] + 1


def allocate(begins: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether it crosses a boundary. Section k is [bounds[k], bounds[k + 1])."""
    first = np.searchsorted(bounds, begins, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "first" or not crossing.any():
        return first, crossing
    if rule == "last":
        return last, crossing
    owner = first.copy()
    for t in np.flatnonzero(crossing):
        own = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[own + 1], ends[t]) - np.maximum(bounds[own], begins[t])
        owner[t] = own[np.argmax(held)]
    return owner, crossing


def section_counts(tables: BytePairTable, cache: dict, pieces: list[str], bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and crossing tokens. Pieces inside a section count at once, others token by token."""
    counts = np.fromiter((len(cache[p]) for p in pieces), np.int64, len(pieces))
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    begins = ends - np.fromiter(map(len, pieces), np.int64, len(pieces))
    section, crossing = allocate(begins, ends, bounds, "first")
    total = np.bincount(section[~crossing], weights=counts[~crossing], minlength=len(bounds) - 1).astype(np.int64)
    crossed = 0
    for i in np.flatnonzero(crossing):
        a, b = token_spans(tables, pieces[i], cache[pieces[i]])
        own, over = allocate(a + begins[i], b + begins[i], bounds, rule)
        total += np.bincount(own, minlength=len(total))
        crossed += int(over.sum())
    return total, crossed


def attribute(docs: DataFrame, fields: list[str], lead_of: str | None = None, rule: str = "first", separator: str = "\n", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Tokens of each field of a row, map-only.

    Returns the ``keep`` columns (default ``doc_id``) with n_tokens (of the joined fields), <field>_tokens
    for each field, separator_tokens and n_crossing (tokens over a boundary, allocated by ``rule``). The
    field ``lead_of`` is given as lead_tokens (its first line with the line end) and body_tokens (the rest)
    instead. A null field is empty and gets no tokens; separators stay. Long texts are encoded whole,
    repeated rows repeat, an empty table gives an empty result, and other columns are never read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    keep = keep or ["doc_id"]
    names = [n for f in fields for n in (("lead", "body") if f == lead_of else (f,))]
    shared = broadcast_file(docs.sparkSession, vocabulary or tokenizer_path("byte_bpe_50k.json"))
    new = {"n_tokens": "long"} | {f"{n}_tokens": "long" for n in names} | {"separator_tokens": "long", "n_crossing": "long"}

    def sections(values: list[str | None]) -> tuple[list[int], list[int]]:
        """Bounds, and the place in ``names`` of each section; separators have the place behind the last."""
        bounds, owners, at, k = [0], [], 0, 0
        for i, (f, v) in enumerate(zip(fields, values, strict=True)):
            if i:
                at += len(separator)
                bounds.append(at)
                owners.append(len(names))
            v = v or ""
            if f == lead_of:
                line = v.find("\n") + 1 or len(v)
                bounds.append(at + line)
                owners.append(k)
                k += 1
            at += len(v)
            bounds.append(at)
            owners.append(k)
            k += 1
        return bounds, owners

    def run(batches):
        tables, cache = table_of(shared), {}
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f"__f{i}")) for i in range(len(fields))]
            longest = max(range(len(fields)), key=lambda i: columns[i].nbytes)
            for start, length, _ in slices(batch, f"__f{longest}"):
                rows = list(zip(*[c.slice(start, length).to_pylist() for c in columns], strict=True))
                pieces = [tables.pretokens(separator.join([v or "" for v in row])) for row in rows]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                missing = list({p for own in pieces for p in own} - cache.keys())
                cache.update(zip(missing, tables.ids_of(missing), strict=True))
                found = np.zeros((length, len(names) + 1), np.int64)
                crossed = np.zeros(length, np.int64)
                for r, (row, own) in enumerate(zip(rows, pieces, strict=True)):
                    bounds, owners = sections(row)
                    total, crossed[r] = section_counts(tables, cache, own, np.array(bounds), rule)
                    np.add.at(found[r], owners, total)
                for p in missing:
                    if len(p) >= LONG:
                        del cache[p]
                out = {"n_tokens": found.sum(axis=1)} | {f"{n}_tokens": found[:, i] for i, n in enumerate([*names, "separator"])} | {"n_crossing": crossed}
                yield with_columns(batch, keep, start, length, {k: pa.array(v, pa.int64()) for k, v in out.items()})

    slim = docs.select(*keep, *[F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(fields)])
    return slim.mapInArrow(run, output_schema(docs, keep, new))
