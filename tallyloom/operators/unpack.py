"""Several values packed in one field: split them into one value per row, position kept.

The strings of an Arrow batch are scanned as one byte buffer. Every byte gets a class (quote, delimiter, other) from
vectorised comparisons, multi-byte marks included; a running quote count per string gives the parity, and a delimiter
counts only where the parity is even. Start and end offsets of the pieces become a list array over the same buffer,
which is flattened with the ordinals of its parents. No Python code runs per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: marks that enclose, and marks that separate
QUOTES = ['"', "'", "„", "“", "”", "‟", "«", "»", "‚", "‘", "’", "‹", "›"]
DELIMITERS = list(",;|/\t\n\r\f\v [](){}<>&") + ["·", "•", "、", "，", "；", "／", "｜", " ", " ", " ", " ", "　", "​", "﻿", " ", " ", "\u0085"]

#: A code of the classification: numbers joined by hyphens, with an optional letter at the end.
CODE = r"[0-9]{1,4}(?:-[0-9]+)+[a-z]?"
LABELLED = rf"^{CODE}$"
CAPTIONED = rf"^{CODE}(?:[\s\p{{Z}}]+|[,:;]\s+).*[^\s]"
#: Words that stand between values and are none themselves.
JOINERS = r"(?i)^(und|sowie|u\.?|and|et|oder|bzw\.?|&|\+)$"


def _mark(buf: np.ndarray, marks: list[str], out: np.ndarray) -> None:
    for m in marks:
        b = m.encode()
        if len(b) == 1:
            out |= buf == b[0]
            continue
        n = len(buf) - len(b) + 1
        if n <= 0:
            continue
        hit = buf[:n] == b[0]
        for k in range(1, len(b)):
            hit &= buf[k : k + n] == b[k]
        at = np.flatnonzero(hit)
        for k in range(len(b)):
            out[at + k] = True


def split_strings(strings: pa.Array, quotes: list[str] = QUOTES, delimiters: list[str] = DELIMITERS) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Pieces of every string: (parent ordinal, piece, piece was quoted). Nulls and empty strings have no piece.

    A quote mark opens or closes if a letter or digit does not stand on both sides of it (an apostrophe is none). A
    doubled mark toggles twice and so leaves the parity as it was. If a string has an odd number of marks, its last one
    is ordinary text.
    """
    arr = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    n = len(arr)
    raw = arr.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    base, end = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    if end == base:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, bool)
    buf = np.frombuffer(raw[2], dtype=np.uint8)[base:end]
    off = offsets - base
    size = len(buf)
    word = ((buf >= 48) & (buf <= 57)) | ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122))

    parent = np.repeat(np.arange(n), np.diff(off))
    quote_start = np.zeros(size, bool)  # the first byte of a mark counts it, all its bytes are no text
    quote_bytes = np.zeros(size, bool)
    for m in quotes:
        one = np.zeros(size, bool)
        _mark(buf, [m], one)
        quote_bytes |= one
        b = m.encode()
        first = one & (buf == b[0]) if len(b) == 1 else one & (buf == b[0]) & np.r_[(buf[1:] == b[1]), False]
        quote_start |= first
    same = np.r_[False, parent[1:] == parent[:-1]]
    before = np.r_[False, word[:-1]] & same
    after = np.r_[word[1:] & same[1:], False]
    apostrophe = quote_start & (buf == 39) & before & after
    quote_start &= ~apostrophe
    quote_bytes &= ~apostrophe
    # the last mark of a string with an odd number of them is text
    count = np.zeros(n, np.int64)
    np.add.at(count, parent[quote_start], 1)
    odd = count % 2 == 1
    if odd.any():
        at = np.flatnonzero(quote_start)
        last = np.r_[parent[at][1:] != parent[at][:-1], True]
        drop = at[last & odd[parent[at]]]
        quote_start[drop] = False
        wide = np.array([1 if buf[i] < 0x80 else 2 if buf[i] < 0xE0 else 3 for i in drop])
        for k in range(3):
            sel = drop[wide > k] + k
            quote_bytes[sel[sel < size]] = False

    running = np.cumsum(quote_start)
    at_start = np.r_[0, running][off[:-1]]
    parity = (running - np.repeat(at_start, np.diff(off))) % 2 == 1
    delim = np.zeros(size, bool)
    _mark(buf, delimiters, delim)
    delim &= ~parity
    # maximal stretches without delimiter, cut at string ends
    live = ~delim
    starts = live & (np.r_[True, delim[:-1]] | np.r_[True, parent[1:] != parent[:-1]])
    ends = live & (np.r_[delim[1:], True] | np.r_[parent[1:] != parent[:-1], True])
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    owner = parent[s]
    quoted = quote_bytes[s]
    text = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=text[1:])
    data = buf[live] if delim.any() else buf
    pieces = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(text.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes()))
    return owner, pieces, quoted


def _unquote(pieces: pa.Array) -> pa.Array:
    """Enclosing marks and blanks off, doubled inner marks single."""
    marks = "".join(QUOTES)
    blank = r"[\s\p{Z}]"
    out = pc.replace_substring_regex(pieces, pattern=rf"^({blank}|[{marks}\[\](){{}}])+", replacement="")
    out = pc.replace_substring_regex(out, pattern=rf"({blank})+$", replacement="")
    # one closing mark ends the quotation; a mark before it belongs to the value only if it is doubled
    out = pc.replace_substring_regex(out, pattern=rf"[{marks}]$", replacement="")
    out = pc.replace_substring(out, pattern='""', replacement='"')
    out = pc.replace_substring(out, pattern="''", replacement="'")
    return pc.replace_substring_regex(out, pattern=rf"^({blank})+|({blank}|[,;|])+$", replacement="")


def unpack_batch(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(parent ordinal, value) of every value, in the order of the text."""
    owner, pieces, quoted = split_strings(strings)
    if not len(pieces):
        return owner, pieces
    # a mark that stands alone is no part of a value
    stray = pc.replace_substring_regex(pieces, pattern=rf"^[{''.join(QUOTES)}]+|[{''.join(QUOTES)}]+$", replacement="")
    value = pc.if_else(pa.array(quoted), _unquote(pieces), stray)
    is_code = pc.match_substring_regex(value, LABELLED).to_numpy(zero_copy_only=False)
    captioned = quoted & ~is_code & pc.match_substring_regex(value, CAPTIONED).to_numpy(zero_copy_only=False)
    again = np.flatnonzero(quoted & ~is_code)
    keep = is_code.copy()
    if len(again):
        # a quotation may hold several values, too: then each of its pieces is a code or a word between codes
        sub_owner, sub, _ = split_strings(value.take(pa.array(again)), quotes=[])
        sub_code = pc.match_substring_regex(sub, LABELLED).to_numpy(zero_copy_only=False)
        sub_join = pc.match_substring_regex(sub, JOINERS).to_numpy(zero_copy_only=False)
        other = np.zeros(len(again), np.int64)
        np.add.at(other, sub_owner[~(sub_code | sub_join)], 1)
        codes = np.zeros(len(again), np.int64)
        np.add.at(codes, sub_owner[sub_code], 1)
        packed = (other == 0) & (codes > 0)
        keep[again[captioned[again] & ~packed]] = True
        take = sub_code & packed[sub_owner]
        rank_of = again[sub_owner[take]]
        flat_owner = np.r_[np.flatnonzero(keep), rank_of]
        values = pa.concat_arrays([value.filter(pa.array(keep)), sub.filter(pa.array(take))])
        order = np.lexsort((np.r_[np.zeros(keep.sum(), np.int64), np.arange(take.sum())], flat_owner))
        return owner[flat_owner[order]], values.take(pa.array(order))
    return owner[keep], value.filter(pa.array(keep))


def unpack_field(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row ``(key, field_name, pos, value)`` per value of a string or array<string> ``column``.

    ``pos`` counts from 1 within a row of ``df`` and runs on over the elements of an array. Null, empty and blank fields,
    null elements and strings without a code give no row; repeated codes stay; rows of ``df`` that are equal in ``key`` are
    handled one by one. Other columns of ``df`` are not read, so their names may clash with the output's. The plan is one
    narrow stage: scan, Arrow batches, output; nothing is shuffled, so a hot key cannot slow it down.
    """
    is_array = df.schema[column].dataType.typeName() == "array"
    key_type = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("k"), F.col(column).alias("v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vals = batch.column(0), batch.column(1)
            if is_array:
                row_of = pc.list_parent_indices(vals).to_numpy(zero_copy_only=False)
                strings = pc.list_flatten(vals)
            else:
                row_of, strings = np.arange(len(vals)), vals
            owner, values = unpack_batch(strings)
            rows = row_of[owner] if len(owner) else np.zeros(0, np.int64)
            first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
            at = np.arange(len(rows))
            pos = at - np.maximum.accumulate(np.where(first, at, 0)) + 1 if len(rows) else at
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows)), pa.array([column] * len(rows), pa.string()), pa.array(pos, pa.int64()), values.cast(pa.string())],
                names=["k", "field_name", "pos", "value"],
            )

    return slim.mapInArrow(scan, f"k {key_type}, field_name string, pos bigint, value string").withColumnRenamed("k", key)


def unpack_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of :func:`unpack_field` for several columns."""
    out = None
    for c in columns:
        part = unpack_field(df, key, c)
        out = part if out is None else out.unionByName(part)
    return out
