"""Token counts of documents by a byte-level BPE tokenizer, huge documents by overlap resynchronisation.

A text of up to STEP + OVERLAP code points is encoded whole (its distinct words, see
``Counter``). A longer one is cut into
chunks that overlap by OVERLAP, which Spark deals out as rows of their own; each is
encoded with offsets. Neighbours are spliced at a place where both have a boundary
between pre-tokens: the pattern that splits text looks no further back than its last
boundary, so behind a common one both chunks agree with the whole text, provided that the
left chunk's is the whole text's. It is if it lies behind that chunk's own splice and so
far before its end that no rule and no special token can reach beyond the chunk
(``margin``). By induction the chunk's counts between its splices add up to the whole
text's. Boundaries between tokens of one pre-token prove nothing and are not used.

Where a seam has no common boundary (one pre-token fills the overlap) the overlap is
widened to the whole next chunk, which the left one takes in, and the seams are tried
again; in the end a text is one chunk. What a chunk reports are the boundaries of its two
overlaps; seams are joined by (text, start) and no document is gathered anywhere.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import KEY, Scratch, arrow_map, key_of_text

STEP, OVERLAP, LIMIT = 1 << 15, 1 << 10, 512
#: Code points that are encoded or counted in one call.
SLICE = 1 << 18
_KEY_DDL = "k_none boolean, k_id long, k_text long"


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def margin(model: bytes) -> int:
    """Code points behind a boundary that can decide whether it is one.

    Contractions look two ahead, white space one; a special token is seen from its first
    code point to its last. Only tokenizers are taken for which this holds.
    """
    j = json.loads(model)
    pre = j.get("pre_tokenizer") or {}
    if j.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers without normalisation and prefix are supported")
    if j.get("truncation") or j.get("padding") or (j.get("post_processor") or {}).get("trim_offsets"):
        raise ValueError("truncation, padding and trimmed offsets are not supported")
    added = j.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens must match as they stand")
    return 4 + max((len(t["content"]) for t in added), default=0)


@lru_cache(maxsize=2)
def _tokenizer(model: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; the library's own threads would crowd the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model.decode())


def boundaries(encoded) -> tuple[np.ndarray, np.ndarray]:
    """Offsets where pre-tokens begin, and the number of tokens before each."""
    words = np.array([-1 - k if w is None else w for k, w in enumerate(encoded.word_ids)], dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    offsets = encoded.offsets
    return np.array([offsets[k][0] for k in first.tolist()], dtype=np.int64), first


#: A space behind one of these may belong to a run of white space that begins before it; all other characters are no white space by any table.
_DOUBTFUL = r"\s\u180e\u200b-\u200d\u2060\ufeff"
_DOUBT, _CUT = re.compile(f"[{_DOUBTFUL}] "), re.compile(f"(?<=[^{_DOUBTFUL}]) ")
#: Words whose counts are kept, in each of two generations, and characters of the longest that is.
KEPT_WORDS, LONGEST = 250_000, 48


class Counter:
    """Tokens of texts, cut before each space that follows no white space, and so is the begin of a pre-token whatever comes before.

    Words repeat, so the library encodes each distinct one of a slice once; counts are
    kept in a bounded table, which costs time when it is dropped and never a result.
    """

    def __init__(self, model: bytes) -> None:
        self.encode = _tokenizer(model).encode_batch_fast
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _encoded(self, pieces: list[str]) -> list[int]:
        return [len(e) for i, j in _slices(pieces) for e in self.encode(pieces[i:j], add_special_tokens=False)]

    def _known(self, words: set[str]) -> list[str]:
        """Sees to it that all words are in ``young``; gives those that must not stay there."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > KEPT_WORDS:
            self.old, self.young, new = self.young, {}, words
        young, old = self.young, self.old
        young.update((w, old[w]) for w in new if w in old)
        fresh = [w for w in new if w not in young]
        young.update(zip(fresh, self._encoded([" " + w for w in fresh])))
        return [w for w in fresh if len(w) > LONGEST]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i, j in _slices(texts):
            words = [_CUT.split(t) if _DOUBT.search(t) else t.split(" ") for t in texts[i:j]]
            first = self._encoded([w[0] for w in words])
            passing = self._known({w for own in words for w in own[1:]})
            of = self.young.__getitem__
            out += [n + sum(map(of, own[1:])) for n, own in zip(first, words)]
            for w in passing:
                del self.young[w]
        return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield at, k
            at, size = k, 0
        size += len(t) + 64
    if at < len(texts):
        yield at, len(texts)


@lru_cache(maxsize=2)
def _counter(model: bytes) -> Counter:
    return Counter(model)


def _whole(texts: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of ``texts(doc_id, n_bytes, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count(b.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return arrow_map(texts, run, "doc_id long, n_bytes long, n_tokens long")


_PIECE = f"{_KEY_DDL}, n_bytes long, start int, stop int, after int, piece string"
_CHUNK = f"{_KEY_DDL}, n_bytes long, start int, stop int, after int, n int, left_at array<int>, left_n array<int>, right_at array<int>, right_n array<int>"


def _pieces(ranges: DataFrame) -> DataFrame:
    """Cuts ``ranges(KEY, n_bytes, text, at array<struct<start, stop, after>>)`` into rows; each text is sliced in its own Arrow row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                key, text = [b.column(c)[k].as_py() for c in range(4)], b.column(4)[k].as_py()
                at = b.column(5)[k].as_py()
                for i in range(0, len(at), 64):
                    some = at[i : i + 64]
                    columns = [pa.array([v] * len(some), t) for v, t in zip(key, (pa.bool_(), pa.int64(), pa.int64(), pa.int64()))]
                    columns += [pa.array([r[c] for r in some], pa.int32()) for c in ("start", "stop", "after")]
                    columns.append(pa.array([text[r["start"] : r["stop"]] for r in some], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PIECE.split(", ")])

    return arrow_map(ranges.select(*KEY, "n_bytes", "text", "at"), run, _PIECE)


def _cut_near(text: str, low: int, high: int) -> int | None:
    """A place in [low, high] where a pre-token begins for certain."""
    found = _CUT.search(text, low, min(high + 1, len(text)))
    return found.start() if found else None


def _chunk(t, counter: Counter, piece: str, overlap: int, right: int | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a chunk, and the boundaries with the tokens before each: those up to ``overlap`` and those from ``right`` on.

    Only what holds these is encoded with offsets; what lies between, from one certain
    boundary to another, is counted as whole texts are.
    """
    none = np.zeros(0, np.int64)
    end = len(piece) if right is None else right
    a = _cut_near(piece, overlap + 1, end)
    if a is None:
        e = t.encode(piece, add_special_tokens=False)
        at, before = boundaries(e)
        return len(e), at, before, *((none, none) if right is None else (at, before))
    head = t.encode(piece[:a], add_special_tokens=False)
    left_at, left_n = boundaries(head)
    if right is None:
        return len(head) + counter.count([piece[a:]])[0], left_at, left_n, none, none
    b = max((x for x in range(max(a, right - overlap), right + 1) if piece[x] == " " and _CUT.match(piece, x)), default=a)
    middle = len(head) + counter.count([piece[a:b]])[0]
    tail = t.encode(piece[b:], add_special_tokens=False)
    at, before = boundaries(tail)
    return middle + len(tail), left_at, left_n, at + b, before + middle


def _encode(pieces: DataFrame, model: bytes, overlap: int, reach: int) -> DataFrame:
    """Chunks with their token count and the boundaries of both overlaps, absolute, with the tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, counter = _tokenizer(model), _counter(model)
        for b in batches:
            found = []
            for start, stop, after, piece in zip(*(c.to_pylist() for c in b.columns[4:8])):
                n, left_at, left_n, right_at, right_n = _chunk(t, counter, piece, overlap, None if after is None else after - start)
                left = left_at <= overlap
                right = np.zeros(len(right_at), bool) if after is None else (right_at >= after - start) & (right_at <= stop - start - reach)
                found.append((n, left_at[left] + start, left_n[left], right_at[right] + start, right_n[right]))
            columns = list(zip(*found)) or [()] * 5
            lists = [pa.array(c, pa.list_(pa.int32())) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(columns[0], pa.int32()), *lists], [x.split()[0] for x in _CHUNK.split(", ")])

    return arrow_map(pieces, run, _CHUNK)


def _seams(chunks: DataFrame) -> DataFrame:
    """``KEY, start, after, kept``: tokens of the left neighbour before the splice less those of the right one before it; null without a common boundary."""
    a = chunks.where("after is not null").select(*KEY, "start", "after", "right_at", "right_n")
    b = chunks.select(*KEY, F.col("start").alias("after"), "left_at", "left_n")
    spliced = F.array_max(F.array_intersect("right_at", "left_at"))
    tokens = lambda at, n: F.element_at(n, F.array_position(at, F.col("p")).cast("int"))
    kept = F.when(F.col("p").isNotNull(), tokens("right_at", F.col("right_n")) - tokens("left_at", F.col("left_n")))
    return a.join(b, [*KEY, "after"]).withColumn("p", spliced).select(*KEY, "start", "after", kept.cast("long").alias("kept"))


def count_tokens(docs: DataFrame, model: bytes, limit: int = LIMIT, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Tokens are those of the whole text as the library gives them, without begin, end or
    added tokens; a special token's string inside a text is that token. A null text is
    empty and has none. Repeated rows give repeated rows, an empty table none; a null doc_id
    stays null. Only doc_id and text are read, so further columns of any name do no harm.
    ``model`` is the tokenizer file's bytes (2 MB for 50,000 tokens), sent with the functions.
    """
    reach = margin(model)
    if not reach < overlap <= step:
        raise ValueError("the overlap must be longer than the margin and at most a step")
    scratch = Scratch(docs.sparkSession, "tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    huge = F.length(text) > step + overlap
    n_bytes = F.octet_length(text).cast("long").alias("n_bytes")
    short = _whole(docs.where(~huge).select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes, text.alias("text")), model)
    long_ = docs.where(huge).select(*key_of_text(), n_bytes, text.alias("text"), F.length(text).alias("n"))
    # A last chunk within the overlap of the one before it would add nothing.
    starts = F.sequence(F.lit(0), F.col("n") - overlap - 1, F.lit(step))
    last = F.size(starts) - 1
    ranges = F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.when(k < last, s + step + overlap).otherwise(F.col("n")).alias("stop"), F.when(k < last, s + step).alias("after")))
    first = _pieces(long_.withColumn("at", ranges)).repartition(*KEY, "start")
    chunks = scratch.write(_encode(first, model, overlap, reach))
    copies = chunks.where("start = 0").groupBy(*KEY).agg(F.count("*").alias("copies"))
    chunks = scratch.write(chunks.dropDuplicates([*KEY, "start"]))
    seams = scratch.write(_seams(chunks))
    while seams.where("kept is null").limit(1).count():
        broken = seams.where("kept is null").select(*KEY).distinct()
        # A chunk starts a new run unless the seam before it failed; a run becomes one chunk.
        joined = seams.where("kept is null").select(*KEY, F.col("after").alias("start"), F.lit(1).alias("joined"))
        order = W.partitionBy(*KEY).orderBy("start")
        runs = chunks.join(broken, KEY, "left_semi").select(*KEY, "start", "stop", "after").join(joined, [*KEY, "start"], "left")
        runs = runs.withColumn("run", F.sum(F.when(F.col("joined").isNull(), 1).otherwise(0)).over(order)).groupBy(*KEY, "run")
        merged = runs.agg(F.count("*").alias("m"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max_by("after", "start").alias("after")).where("m > 1")
        again = scratch.write(merged.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop", "after")).alias("at")))
        taken = _pieces(long_.select(*KEY, "n_bytes", "text").join(again, KEY)).repartition(*KEY, "start")
        wider = scratch.write(_encode(taken, model, overlap, reach)).dropDuplicates([*KEY, "start"])
        inside = again.select(*KEY, F.explode("at").alias("r")).select(*KEY, F.col("r.start").alias("from"), F.col("r.stop").alias("to")).alias("i")
        c = chunks.alias("c")
        # A chunk goes if a wider one holds it whole.
        same = [F.col(f"c.{k}") == F.col(f"i.{k}") for k in KEY]
        rest = c.join(inside, [*same, F.col("c.start") >= F.col("i.from"), F.col("c.stop") <= F.col("i.to")], "left_anti")
        chunks = scratch.write(rest.unionByName(wider))
        seams = scratch.write(_seams(chunks))
    ends = chunks.where("after is null").select(*KEY, "n_bytes", F.col("n").cast("long").alias("tail"))
    total = seams.groupBy(*KEY).agg(F.sum("kept").alias("kept"))
    whole = ends.join(total, KEY, "left").join(copies, KEY).select(F.when(~F.col("k_none"), F.col("k_id")).alias("doc_id"), "n_bytes", (F.col("tail") + F.coalesce("kept", F.lit(0))).alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("c")).drop("c")
    return short.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit)
