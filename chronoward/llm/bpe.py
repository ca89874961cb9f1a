"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Encoding: a text is split by the tokenizer's pattern; every distinct match of a batch becomes rows of
(word, position, token), one for each byte. A recursive query joins neighbouring rows with the merge table and
contracts each word's leftmost pair of least rank until no word has a pair left. Decoding joins ids with the
vocabulary and concatenates the bytes by an ordered aggregate.

Nulls count as empty texts: no tokens, and the digests of empty byte strings. Repeated documents are separate rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices

#: Words whose encoding a Python worker remembers over its tasks, rows of one recursion with all its steps, ids decoded by one query.
CACHE_WORDS, RECURSION_ROWS, DECODE_IDS = 350_000, 3_000_000, 400_000
#: Bytes from which a match goes to the recursion for long matches; both give the same ids.
LONG = 12_000

STEP = """
WITH RECURSIVE state(step, w, pos, npos, id, nid) AS (
    SELECT 0, w, pos, npos, id, nid FROM start
  UNION ALL
    (WITH best AS MATERIALIZED (
        SELECT w, min_by({{'p': pos, 'q': npos, 'merged': m.rank}}, m.rank::BIGINT * 4294967296 + pos) AS c
        FROM state s JOIN merges m ON m.l = s.id AND m.r = s.nid GROUP BY w),
     pair AS MATERIALIZED (
        SELECT b.w, c.p AS p, c.q AS q, c.merged AS merged, s.npos AS qnext, s.nid AS qnid
        FROM best b JOIN state s ON s.w = b.w AND s.pos = c.q)
     SELECT r.step + 1, r.w, r.pos,
            CASE WHEN r.pos = c.p THEN c.qnext ELSE r.npos END,
            CASE WHEN r.pos = c.p THEN c.merged ELSE r.id END,
            CASE WHEN r.pos = c.p THEN c.qnid WHEN r.npos = c.p THEN c.merged ELSE r.nid END
     FROM state r JOIN pair c ON c.w = r.w
     WHERE r.pos <> c.q AND r.step < {steps})
), last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT s.w, s.step, list(s.id ORDER BY s.pos) AS ids
FROM state s JOIN last l ON s.w = l.w AND s.step = l.step GROUP BY s.w, s.step
"""

#: The same for long matches. A row knows the rank of the pair that begins there, and a step writes changed rows alone. The pairs
#: of a word's least rank are contracted together, from left to right, where the token that they make can form no pair of a lower
#: rank in this match (`calm`): then the next least pair is again of that rank. Elsewhere the leftmost alone. A row with id -1 is gone.
LONG_STEP = """
WITH RECURSIVE state(w, pos, npos, id, nid, rank) USING KEY (w, pos) AS (
    SELECT s.w, s.pos, s.npos, s.id, s.nid, m.rank FROM start s LEFT JOIN near_merges m ON m.l = s.id AND m.r = s.nid
  UNION
    (WITH best AS MATERIALIZED (
        SELECT w, min(rank::BIGINT * 4294967296 + pos) AS c FROM recurring.state WHERE rank IS NOT NULL GROUP BY w),
     least AS MATERIALIZED (
        SELECT b.w, (b.c >> 32)::INTEGER AS rank, CASE WHEN k.id IS NULL THEN (b.c & 4294967295)::INTEGER END AS only_pos
        FROM best b LEFT JOIN near_calm k ON k.id = b.c >> 32),
     equal_pairs AS MATERIALIZED (
        SELECT s.w, s.pos AS p, s.npos AS q, s.rank AS merged,
               coalesce(lag(s.npos) OVER (PARTITION BY s.w ORDER BY s.pos) = s.pos, false) AS joined,
               row_number() OVER (PARTITION BY s.w ORDER BY s.pos) AS k
        FROM recurring.state s JOIN least l ON l.w = s.w AND l.rank = s.rank AND (l.only_pos IS NULL OR l.only_pos = s.pos)),
     runs AS (
        SELECT *, max(CASE WHEN NOT joined THEN k END) OVER (PARTITION BY w ORDER BY k ROWS UNBOUNDED PRECEDING) AS begun
        FROM equal_pairs),
     hits AS MATERIALIZED (
        SELECT r.w, r.p, r.q, r.merged, s.npos AS qnext, s.nid AS qnid
        FROM runs r JOIN recurring.state s ON s.w = r.w AND s.pos = r.q WHERE (r.k - r.begun) % 2 = 0),
     changed AS (
        SELECT h.w, h.p AS pos, h.qnext AS npos, h.merged AS id, coalesce(n.merged, h.qnid) AS nid
        FROM hits h LEFT JOIN hits n ON n.w = h.w AND n.p = h.qnext
      UNION ALL
        SELECT s.w, s.pos, s.npos, s.id, h.merged
        FROM recurring.state s JOIN hits h ON h.w = s.w AND h.p = s.npos
        WHERE s.id >= 0 AND NOT EXISTS (FROM hits x WHERE x.w = s.w AND x.q = s.pos))
     SELECT c.w, c.pos, c.npos, c.id, c.nid, m.rank FROM changed c LEFT JOIN near_merges m ON m.l = c.id AND m.r = c.nid
     UNION ALL SELECT w, q, -1, -1, -1, NULL FROM hits)
)
SELECT w, list(id ORDER BY pos) AS ids FROM state WHERE id >= 0 GROUP BY w
"""

#: The merges whose three tokens occur in the match, and the tokens that are `calm` among them.
NEAR = """
CREATE OR REPLACE TEMP TABLE near_merges AS
SELECT m.* FROM merges m SEMI JOIN here a ON a.id = m.l SEMI JOIN here b ON b.id = m.r SEMI JOIN here c ON c.id = m.rank;
CREATE OR REPLACE TEMP TABLE near_calm AS
SELECT id FROM here ANTI JOIN (SELECT l AS id FROM near_merges WHERE rank < l UNION ALL SELECT r FROM near_merges WHERE rank < r) USING (id);
"""

DECODE = """
SELECT part, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM given g JOIN vocabulary v ON v.id = g.id GROUP BY part ORDER BY part
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The merge table, the vocabulary and a DuckDB connection of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        for name, columns in (("merges", {k: np.array(v, dtype=np.int32) for k, v in (("l", left), ("r", right), ("rank", rank))}), ("vocabulary", {"id": np.array(list(ranks.values()), dtype=np.int32), "hex": [t.hex() for t in ranks]})):
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.sizes = sorted({len(t) for t in ranks})
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids, four bytes each, of every word, by the recursive query."""
        done: list[bytes] = [b""] * len(words)
        pending = []
        for i, w in enumerate(words):
            ids = self.single[np.frombuffer(w, dtype=np.uint8)]
            if len(w) >= LONG:
                done[i] = self._long(w, ids)
            else:
                pending.append((i, ids))
        while pending:
            pending.sort(key=lambda x: len(x[1]))
            group, rows = [], 0
            while pending and (not group or rows + len(pending[-1][1]) <= RECURSION_ROWS // (len(group[0][1]) + 1)):
                group.append(pending.pop())
                rows += len(group[-1][1])
            steps = max(1, RECURSION_ROWS // rows)
            lengths = np.array([len(x) for _, x in group])
            ids, ends = np.concatenate([x for _, x in group]), np.cumsum(lengths)
            pos = np.arange(rows) - np.repeat(ends - lengths, lengths)
            last = pos == np.repeat(lengths, lengths) - 1
            npos, nid = np.where(last, -1, pos + 1), np.where(last, -1, np.append(ids[1:], -1))
            self.db.register("start", pa.table({k: v.astype(np.int32) for k, v in (("w", np.repeat(np.arange(len(group)), lengths)), ("pos", pos), ("npos", npos), ("id", ids), ("nid", nid))}))
            found = self.db.sql(STEP.format(steps=steps)).to_arrow_table()
            self.db.unregister("start")
            lists = found["ids"].combine_chunks()
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = values.astype("<u4").tobytes()
            for k, (w, step) in enumerate(zip(found["w"].to_pylist(), found["step"].to_pylist())):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if step >= steps:  # not at its fixpoint yet: goes on from here
                    pending.append((group[w][0], values[a:b].copy()))
                else:
                    done[group[w][0]] = raw[4 * a : 4 * b]
        return done

    def _long(self, word: bytes, ids: np.ndarray) -> bytes:
        """Token ids of one long match."""
        n = len(ids)
        found = set().union(*({word[i : i + k] for i in range(n - k + 1)} & self.ranks.keys() for k in self.sizes if k <= n))
        self.db.register("here", pa.table({"id": np.array([self.ranks[t] for t in found], dtype=np.int32)}))
        self.db.execute(NEAR)
        self.db.unregister("here")
        npos, nid = np.append(np.arange(1, n), -1), np.append(ids[1:], -1)
        self.db.register("start", pa.table({k: v.astype(np.int32) for k, v in (("w", np.zeros(n)), ("pos", np.arange(n)), ("npos", npos), ("id", ids), ("nid", nid))}))
        found = self.db.sql(LONG_STEP).to_arrow_table()
        self.db.unregister("start")
        return found["ids"].combine_chunks().values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self.split.findall(t) for t in texts]
        todo = {w: w.encode() for w in set().union(*split).difference(self.cache)}
        hard = []
        for w, raw in todo.items():
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[w] = whole.to_bytes(4, "little")
            else:
                hard.append(w)
        self.cache.update(zip(hard, self.merge([todo[w] for w in hard])))
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        out = [b""] * len(ids)
        parts, size = [], 0
        for i, x in enumerate(ids):
            values = np.frombuffer(x, dtype="<u4")
            for at in range(0, len(values), DECODE_IDS):
                parts.append((i, values[at : at + DECODE_IDS]))
                size += len(parts[-1][1])
                if size >= DECODE_IDS:
                    self._decode(parts, out)
                    parts, size = [], 0
        if parts:
            self._decode(parts, out)
        return out

    def _decode(self, parts, out) -> None:
        lengths = [len(x) for _, x in parts]
        ids = np.concatenate([x for _, x in parts])
        self.db.register("given", pa.table({"part": np.repeat(np.arange(len(parts)), lengths), "pos": np.arange(len(ids)), "id": ids.astype(np.int32)}))
        for k, x in self.db.execute(DECODE).fetchall():
            out[parts[k][0]] += bytes.fromhex(x)
        self.db.unregister("given")


_CODECS: dict[tuple, Codec] = {}


def codec_of(ranks: dict[bytes, int], pattern: str, key: str) -> Codec:
    """The codec of this Python worker, kept from task to task with the words that it has seen."""
    if (key, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[key, pattern] = Codec(ranks, pattern)
    return _CODECS[key, pattern]


def batches(texts: list[str | None], most: int = 1_500_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about `most` characters together (a longer text stands alone), with the place of the first."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        if group and size + len(t or "") > most:
            yield first, group
            first, group, size = i, [], 0
        group.append(t or "")
        size += len(t or "")
    if group:
        yield first, group


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of every document; with `keep_ids`, the ids as well.

    Only doc_id and text are read, so other columns of any name do no harm. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = read_ranks(ranks_path)
    key = hashlib.sha256(b"\n".join(b"%d %b" % (r, t) for t, r in table.items())).hexdigest()
    ranks = spark.sparkContext.broadcast(table)  # a vocabulary file: its size does not depend on the data

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches_in, 500):
            codec = codec_of(ranks.value, pattern, key)
            texts, rows = batch.column(1).to_pylist(), []
            for _, group in batches(texts):
                encoded = codec.encode(group)
                for ids, raw in zip(encoded, codec.decode(encoded)):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)) + ((np.frombuffer(ids, dtype="<u4").astype(np.int32),) if keep_ids else ()))
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
