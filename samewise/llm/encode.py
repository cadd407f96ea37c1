"""Token ids of a whole corpus by a byte-level BPE vocabulary, where text that documents share is encoded once.

Documents are cut into chunks where a rolling hash of the last bytes says so, so the same stretch of text gives the same chunks in
whatever document it stands. Each distinct chunk is encoded once; documents are then put together from their chunks' ids. At a
chunk's end the ids can differ from those of the whole text. What the splitting pattern finds from a position on depends only on
the text from there on, so a join is repaired by splitting again from the last piece that can't depend on the next chunk, until a
piece ends where the next chunk, split alone, also has an end. From there on both agree, and the chunk's own ids hold.

What a join needs is known from the text alone: how many bytes of either chunk's ids hold, and the ids between them. So joins are
settled where the text is cut, and from there on documents travel as the keys of their chunks; no text is shuffled but the
distinct chunks, once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.session import staged, table

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece that ends at least so many characters before the end of its text doesn't depend on what follows: the longest contraction is 3 long.
_SEEN = 3
_WINDOW = 16


@lru_cache(4)
def encoding(tokenizers: str, name: str) -> tiktoken.Encoding:
    lines = (Path(tokenizers) / f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_split = regex.compile(PATTERN)
#: In UTF-16 or bytes, positions would need mapping; all positions here are characters of Python strings.
_gap = regex.compile(r"(?<=\S)\s")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GEAR = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ ((np.arange(1, 257, dtype=np.uint64) * _MIX) >> np.uint64(29))


def chunks(text: str, mean: int, most: int) -> list[str]:
    """text in pieces that depend on their own content: a cut falls where a gap begins and the rolling hash of the bytes before it
    is 0 in its upper bits, about every mean characters; pieces longer than most (few gaps) are cut there. "" gives none."""
    if len(text) <= mean // 2:
        return [text] if text else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gear = _GEAR[codes & 255] * (codes.astype(np.uint64) | np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(gear, dtype=np.uint64)])
    at = np.fromiter((m.start() for m in _gap.finditer(text)), np.int64)
    if len(at):
        # The window's sum, mixed: it rolls by one addition and one subtraction a character.
        h = (sums[at] - sums[np.maximum(at - _WINDOW, 0)]) * _MIX >> np.uint64(40)
        at = at[h % np.uint64(max(1, mean // 6)) == 0]  # a gap comes every 6 characters or so
    out, start = [], 0
    for end in [*at.tolist(), len(text)]:
        while end - start > most:
            out.append(text[start : start + most])
            start += most
        if end > start:
            out.append(text[start:end])
            start = end
    return out


def _ends(text: str, limit: int | None = None) -> list[int]:
    """Where the pieces of text end, the first limit of them or all."""
    out = []
    for m in _split.finditer(text):
        out.append(m.end())
        if limit and len(out) >= limit:
            break
    return out


Part = tuple[str, int, int, list[int]]


def _bytes(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def joints(parts: list[str], enc: tiktoken.Encoding) -> list[Part]:
    """Of each chunk (text, from, to, then): its ids hold from that byte on up to that one (-1: to its end), then come the ids `then`.
    Chunks whose join doesn't come to an agreement are one chunk."""
    out: list[Part] = []
    text, start = None, 0  # the chunk whose end is still open, and where in it (in characters) its own ids begin to hold
    for new in parts:
        if text is None:
            text = new
            continue
        last = text[start:]
        if new[:1].isspace() and last[-1:] and not last[-1:].isspace():
            out.append((text, _bytes(text[:start]), -1, []))  # a piece never goes from a character into white space: this join is exact
            text, start = new, 0
            continue
        keep = max((e for e in _ends(last) if e <= len(last) - _SEEN), default=0)
        whole = last[keep:] + new
        theirs = iter([0, *_ends(new)])
        at, agreed = next(theirs), None
        pieces = _ends(whole)
        for e in pieces:
            e -= len(last) - keep
            while at is not None and at < e:
                at = next(theirs, None)
            if at == e and 0 < e <= len(new) - _SEEN:
                agreed = e
                break
        if agreed is None:
            if keep:  # what comes before the open end stands by itself
                out.append((text, _bytes(text[:start]), _bytes(text[: start + keep]), []))
            text, start = whole, 0
            continue
        then, a = [], 0
        for e in pieces:  # each by itself: white space at the end of a shorter text would be split otherwise
            if e > len(last) - keep + agreed:
                break
            then.extend(enc.encode_ordinary(whole[a:e]))
            a = e
        out.append((text, _bytes(text[:start]), _bytes(text[: start + keep]), then))
        text, start = new, agreed
    if text is not None:
        out.append((text, _bytes(text[:start]), -1, []))
    return out


def assembled(own: list[list[int]], joins: list[tuple[int, int, list[int]]], sizes: list[int]) -> list[int]:
    """The ids of a document from the ids of its chunks and (from, to, then) of each."""
    ids: list[int] = []
    for x, (lo, hi, then) in zip(own, joins, strict=True):
        ids.extend(x[_ids_until(x, sizes, lo) : len(x) if hi < 0 else _ids_until(x, sizes, hi)])
        ids.extend(then)
    return ids


def join_ids(parts: list[tuple[str, list[int]]], enc: tiktoken.Encoding) -> list[int]:
    """The ids of the joined texts, the joins repaired. Exactly enc.encode_ordinary("".join(texts))."""
    known = dict(parts)
    plan = joints([t for t, _ in parts], enc)
    return assembled([known[t] if t in known else enc.encode_ordinary(t) for t, *_ in plan], [x[1:] for x in plan], enc_sizes(enc))


def _ids_until(ids: list[int], sizes: np.ndarray, n_bytes: int) -> int:
    """How many of ids make up the first n_bytes of their text, where a piece ends."""
    total = k = 0
    while total < n_bytes:
        total += sizes[ids[k]]
        k += 1
    return k


@lru_cache(4)
def enc_sizes(enc: tiktoken.Encoding) -> list[int]:
    """The bytes of each token."""
    out = [0] * enc.n_vocab
    for b, i in enc._mergeable_ranks.items():
        out[i] = len(b)
    return out


def encode(df: DataFrame, ident: str, text: str, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, mean_chars: int = 160, most_chars: int = 4096) -> DataFrame:
    """ident and ids (ARRAY<INT>): the token ids of text for each row of df, without special tokens, whose strings are ordinary text.

    Empty and null texts give an empty list; white space is encoded like any text. ident may be null or repeated: a row stands for
    itself. Rows aren't capped or dropped, texts are encoded whole. mean_chars and most_chars: size of the chunks.
    """
    rows = df.select(F.col(f"`{ident}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizers, vocabulary)
        for pdf in batches:
            plans = [joints(chunks(t, mean_chars, most_chars), enc) for t in pdf["text"]]
            # most joins are exact: what they hold from and to takes no space where it says nothing
            cols = {"parts": [[p[0] for p in x] for x in plans], "lo": [[p[1] for p in x] for x in plans], "hi": [[p[2] for p in x] for x in plans], "then": [[p[3] for p in x] for x in plans]}
            yield pd.DataFrame({"doc": pdf["doc"], "row": pdf["row"], **cols})

    # The row's number is drawn once and written: a row keeps it whatever is computed again.
    kind = dict(df.dtypes)[ident]
    shape = f"doc {kind}, row long, parts array<string>, lo array<int>, hi array<int>, then array<array<int>>"
    cut = staged(rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(cut_up, shape), "chunks")
    key = F.unhex(F.md5("part"))

    def encode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizers, vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "ids": [enc.encode_ordinary(p) for p in pdf["part"]]})

    distinct = cut.select(F.explode("parts").alias("part")).distinct().select(key.alias("key"), "part")
    encoded = distinct.mapInPandas(encode_all, "key binary, ids array<int>")
    found = cut.select("row", F.posexplode("parts").alias("k", "part")).select("row", "k", key.alias("key")).join(encoded, "key")
    of_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("got"))

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = enc_sizes(encoding(tokenizers, vocabulary))
        for pdf in batches:
            out = []
            for got, *joins in zip(pdf["got"], pdf["lo"], pdf["hi"], pdf["then"]):
                own = [] if got is None else [list(g) for g in got]
                out.append(assembled(own, [(int(a), int(b), list(c)) for a, b, c in zip(*joins)], sizes))
            yield pd.DataFrame({ident: pdf["doc"], "ids": out})

    joined = cut.join(of_row.select("row", F.col("got.ids").alias("got")), "row", "left").select("doc", "lo", "hi", "then", "got")
    return joined.mapInPandas(put_together, f"`{ident}` {kind}, ids array<int>").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much text was encoded once for several places: chunks and characters, all and distinct."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": [p for t in pdf["text"] for p in chunks(t, 160, 4096)]})

    parts = docs.mapInPandas(cut_up, "part string").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return parts.agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.length("part")).alias("chars"), F.sum(F.length("part")).alias("distinct_chars")
    )


QUERIES = {"p7_ids": p7_ids, "p7_reuse": p7_reuse}
ORACLES: dict[str, str] = {}
