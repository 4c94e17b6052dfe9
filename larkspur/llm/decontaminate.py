"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive words of the normalised benchmark texts is a pattern
of one automaton, which scans each normalised document once. The positions of what
it finds are mapped back to words, and to characters of the original text. Where the
patterns pass MAX_PATTERN_CHARS, they are cut into shards, and each worker holds one
shard's automaton at a time over a chunk of the documents that it reads; what the shards
find in a row is united in that row, so the result is that of one automaton.

Cases: a null or empty text has no words and no hits; an item without words, or whose
id is null, has no windows; an item of fewer than ten words is one window; items of
equal text or id are reported by their distinct ids; a document row gets the result of
its own text, whether its id is null, repeated or neither; an empty benchmark gives zero
hits everywhere. Only the id and the text column are read unless `carry` names more; a
result column replaces a carried one of its name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrowmap import column, remembered, small_batches, tidied
from larkspur.llm.textvec import ALNUM, buffers

WINDOW = 10
#: Characters of patterns in one automaton (about 40 bytes of memory each).
MAX_PATTERN_CHARS = 4_000_000
#: Bytes of documents that a worker holds while it goes through the automata of several shards.
CHUNK_BYTES = 64 << 20

_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    words = normal_words((text or "").encode())
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def automaton(key: str, sent):
    """The automaton of the broadcast patterns (window, ids); a Python worker holds the last one. Bytes are its letters, so offsets are byte offsets."""
    held = remembered("decontaminate")
    if key not in held:
        import ahocorasick

        held.clear()
        made = ahocorasick.Automaton()
        for window, ids in sent.value:
            made.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
        vars(sent).pop("_value", None)  # a worker need not keep the patterns beside their automaton
        if len(made):
            made.make_automaton()
        held[key] = made
    return held[key]


def scan(words: list[bytes], made) -> tuple[set[str], list[tuple[int, int]]]:
    """The items found, and the word ranges of occurrences."""
    if not words or not len(made):
        return set(), []
    line = b" " + b" ".join(words) + b" "
    found = list(made.iter(line.decode("latin-1")))
    if not found:
        return set(), []
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(gaps, [end for end, _ in found])  # the word before this gap
    items = {i for _, (_, ids) in found for i in ids}
    return items, [(stop - size, stop) for stop, (_, (size, _)) in zip(last.tolist(), found)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as character ranges of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[at[lo][0]]), "stop": int(chars[at[hi - 1][1]])} for lo, hi in ranges]


def shards(items: DataFrame, item_id: str, text: str, most: int):
    """Lists of (window, item ids), each of at most `most` characters of patterns where one item allows it."""
    one = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    chars = one.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] * WINDOW
    parts = max(1, -(-chars // most))
    for part in range(parts):
        rows = one.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).toLocalIterator()  # a part is bounded by `most`
        by: dict[bytes, set[str]] = {}
        for row in rows:
            for w in windows(row.t):
                by.setdefault(w, set()).add(row.id)
        yield [(w, sorted(ids)) for w, ids in sorted(by.items())]


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (), most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """For each document: n_words, n_hit (words inside occurrences), the items found, and the character spans hit."""
    spark = docs.sparkSession
    new = ("n_words", "n_hit", "items", "spans")
    names = [c for c in docs.columns if c in {doc_id, *carry} and c not in new]
    own = [f"`{c}` {t}" for c, t in docs.dtypes if c in names]
    source = docs.select(*dict.fromkeys([*names, text]))
    sent = [(uuid.uuid4().hex, spark.sparkContext.broadcast(patterns)) for patterns in shards(items, item_id, item_text, most)]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = []
        for batch in held:
            data, at = buffers(column(batch, text))
            raw.append([data[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)])
        hits = [[(set(), []) for _ in texts] for texts in raw]
        words = [list(map(normal_words, texts)) for texts in raw] if len(sent) == 1 else None
        for key, patterns in sent:
            made = automaton(key, patterns)
            for b, texts in enumerate(raw):
                for i, t in enumerate(texts):
                    ids, ranges = scan(words[b][i] if words else normal_words(t), made)
                    hits[b][i][0].update(ids)
                    hits[b][i][1].extend(ranges)
        for b, batch in enumerate(held):
            n = [len(words[b][i] if words else normal_words(t)) for i, t in enumerate(raw[b])]
            ranges = [merged(r) for _, r in hits[b]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, c) for c in names),
                    pa.array(n, pa.int64()),
                    pa.array([sum(hi - lo for lo, hi in r) for r in ranges], pa.int64()),
                    pa.array([sorted(ids) for ids, _ in hits[b]], pa.list_(pa.string())),
                    pa.array([char_spans(t, r) for t, r in zip(raw[b], ranges)], span),
                ],
                names=[*names, *new],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if held and (len(sent) == 1 or size >= CHUNK_BYTES):
                yield from found(held)
                held, size = [], 0
        if held:
            yield from found(held)

    small_batches(spark)
    return source.mapInArrow(tidied(run, "decontaminate"), ", ".join([*own, RESULT]))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: the words inside occurrences of benchmark windows, and a digest of the items found."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
g AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
o AS (SELECT r, i, size, item FROM g JOIN p USING (size, g)),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + size)) AS j FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
