"""Spelling variants: words one edit apart, by Gram matrices over blocks of letter counts.

Words one edit apart differ in length by one at most, and cutting the shorter into three parts leaves at least
two of them whole in both: the first two, the first and the last, or the last two. Words that share two such
parts, in equal or adjacent lengths, stand in one block. The products of a block's letter counts give all squared
distances at once; one edit leaves a distance of two at most, and such pairs are verified letter by letter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm.shared import pieces, shuffle_parts, stored, table, utf8

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, GARBLED = 7, 2, 10, 31
LETTERS = 26 + 64
TILE = 1024  # words of one key that are multiplied with as many others
WIDE = 256  # letters of a word that is laid out in one matrix with others
PACKED = 128  # rows of small blocks that share one product
FLUSH = 1 << 18  # distinct words a task counts before it sends them on
_PIECE = 4 << 20


def counted(doc_id: str, text: str, least: int, into: Counter) -> None:
    """Adds the words of a document: its runs, one letter short where the checksum of id and run says so."""
    begin = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        if len(run) >= least:
            h = zlib.crc32(run.encode(), begin)
            if h % GARBLED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                into[run] += n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH,
                times: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``least`` letters that occur at least ``times`` times.

    A null text has no word; a null id counts as the empty string. Every row counts, repeated ones too.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in pieces(batch, 1, _PIECE):
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counted(name, text, least, held)
                    if len(held) >= FLUSH:
                        yield sent()
                        held.clear()
        yield sent()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), utf8(text_col).alias("_text"))
    return (rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= times))


def block_keys(word: str):
    """The keys of a word as ``struct(key, kind, short)``: three as the shorter word of a pair, three as the longer."""
    keys = []
    for less in (0, 1):
        m = F.length(word) - less
        a, c = (m / 3).cast("int"), F.ceil(m / 3).cast("int")
        b = m - a - c
        first, last = (lambda n: F.left(F.col(word), n)), (lambda n: F.right(F.col(word), n))
        for kind, part in enumerate((first(a + b), F.concat(first(a), last(c)), last(b + c))):
            keys.append(F.struct(F.xxhash64(m, F.lit(kind), part).alias("key"), F.lit(kind).alias("kind"),
                                 F.lit(less == 0).alias("short")))
    return F.array(*keys)


def letter_counts(words: list[str]) -> np.ndarray:
    """(word, letter) counts; letters that cannot occur in a word of lower-cased runs share the spare places."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    place = np.where(codes < 0xC0, (codes - 97) % 26, 26 + (codes - 0xC0) % 64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * LETTERS + place, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.float32)


def close_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose squared distance is two at most, from the Gram matrix."""
    gram = x @ y.T
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * gram
    return np.nonzero(distance <= 2)


class Letters:
    """Words as matrices of code points from the front and from the back."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        width = int(self.size.max())
        front = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(-1, width)
        back = np.frombuffer("".join(w[::-1].ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4")
        self.front, self.back = front, back.reshape(-1, width)

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common beginnings and ends of different words."""
        out = []
        for side in (self.front, self.back):
            differ = side[a] != side[b]
            first = differ.argmax(axis=1)
            out.append(np.minimum(np.where(differ.any(axis=1), first, side.shape[1]),
                                  np.minimum(self.size[a], self.size[b])))
        return out[0], out[1]

    def near(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart and share this kind of key first, so that each pair is met once."""
        start, end = self.common(x, y)
        m, longer = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
        one = np.where(m == longer, start + end == m - 1, (longer == m + 1) & (start + end >= m))
        a, c = m // 3, -(-m // 3)
        shared = np.stack((start >= m - c, (start >= a) & (end >= c), end >= m - a))
        first = shared.any(axis=0) & (shared.argmax(axis=0) == kind)
        return one & first


def verified(words: list[str], x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """``Letters.near`` for the pairs of rows; long words are laid out pair by pair."""
    long = np.array([len(w) > WIDE for w in words], bool)
    good = np.zeros(len(x), bool)
    some = np.nonzero(~long[x] & ~long[y])[0]
    if len(some):
        good[some] = Letters(["" if far else w for w, far in zip(words, long, strict=True)]).near(x[some], y[some], kind[some])
    for i in np.nonzero(long[x] | long[y])[0]:
        good[i] = Letters([words[x[i]], words[y[i]]]).near(np.array([0]), np.array([1]), kind[i:i + 1])[0]
    return good


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each word its near words here: how many, and the most frequent one, the least of equals."""
    left, right = np.concatenate((a, b)), np.concatenate((b, a))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[right], -n[right], left))
    left, right = left[order], right[order]
    begin = np.nonzero(np.diff(left, prepend=-1))[0]
    count = np.diff(np.append(begin, len(left)))
    names = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(left[begin])), pa.array(count), pa.array(-n[right[begin]]), names.take(pa.array(right[begin]))],
        names=["word", "n_near", "minus", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``minus`` its count, ``form``) of the words that have near words.

    ``words`` has distinct ``word`` and ``n``. Keys of one word go; a key of many words is cut into tiles by the
    hash of the word, and each pair of tiles is multiplied by one task. What leaves a task is one row for each of
    its words and block, never a pair.
    """
    parts = shuffle_parts(words.sparkSession)
    filed = words.select("word", "n", F.explode(block_keys("word")).alias("_k")).select("word", "n", "_k.*")
    crowded = (filed.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n"), F.max("short").alias("_short"))
               .where("_n > 1 AND _short"))
    met = (filed.join(crowded, F.col("key") == F.col("_key"))
           .withColumn("tiles", F.ceil(F.col("_n") / TILE).cast("int"))
           .withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
           .select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"),
                   (F.col("tile") > F.col("other")).alias("side"), "kind", "short", "word", "n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            some = pa.Table.from_batches(held).combine_chunks()
            keys = [some.column(k).to_numpy() for k in range(3)]
            stop = np.nonzero(np.any([k != k[-1] for k in keys], axis=0))[0]  # the last block may go on
            if len(stop):
                yield from decided(some.slice(0, int(stop[-1]) + 1))
                held = some.slice(int(stop[-1]) + 1).to_batches()
        if held:
            yield from decided(pa.Table.from_batches(held))

    def decided(some: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([some.column(k).to_numpy() for k in range(3)])
        begin = np.nonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))[0]
        ends = np.append(begin[1:], some.num_rows)
        at = 0
        while at < len(begin):  # small blocks share a product
            stop = max(at + 1, int(np.searchsorted(ends, begin[at] + PACKED, "right")))
            yield from multiplied(some.slice(begin[at], ends[stop - 1] - begin[at]),
                                  np.repeat(np.arange(stop - at), ends[at:stop] - begin[at:stop]))
            at = stop

    def multiplied(block: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = block.column(6).to_pylist()
        side, short = block.column(3).to_numpy(), block.column(5).to_numpy()
        kind, n = block.column(4).to_numpy(), block.column(7).to_numpy()
        across = block.column(1).to_numpy() != block.column(2).to_numpy()
        counts = letter_counts(words)
        a = np.nonzero(short)[0]
        x, y = close_pairs(counts[a], counts)
        x = a[x]
        keep = (group[x] == group[y]) & (x != y) & (~short[y] | (x < y)) & (~across[x] | (side[x] != side[y]))
        x, y = x[keep], y[keep]
        good = verified(words, x, y, kind[x])
        if good.any():
            yield _best(words, n, x[good], y[good])

    found = (met.repartition(parts, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
             .mapInArrow(compare, "word string, n_near long, minus long, form string"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "form")).alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word (see ``word_counts``).

    A word's form is the most frequent word near it, if that occurs ``FORM_RATIO`` times as often; ties go to the
    smallest in code-point order. Forms grow by that ratio, so the chain to a root has as many steps as the
    largest count has digits, and is followed by doubling its stride. An empty table gives no row.
    """
    words = stored(word_counts(docs, id_col, text_col))
    near = near_words(words).withColumnRenamed("word", "_word")
    told = stored(words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.minus") >= FORM_RATIO * F.col("n"), F.col("best.form")).alias("form"),
        F.when(-F.col("best.minus") >= FORM_RATIO * F.col("n"), -F.col("best.minus")).alias("form_n")))
    chain = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = told.agg(F.max("form_n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(1 + math.log(most, FORM_RATIO)))):
        ahead = chain.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        chain = stored(chain.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root")))
    roots = chain.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    return told.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce([k::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda v, u: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
    FROM range(256) r(k))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(range(1, strlen(coalesce(doc_id::VARCHAR, '') || ':' || run) + 1),
               lambda i: ('0x' || hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run))[2 * i - 1:2 * i])::BIGINT)),
           lambda v, b: xor(v >> 8, t[1 + (xor(v, b) & 255)]))) AS h
  FROM runs, crc),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END
         AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS bn
  FROM pairs JOIN words ON b = words.word GROUP BY a),
told AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form,
         CASE WHEN bn >= 10 * n THEN bn END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS up FROM told
  UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON c.up = t.word)
SELECT t.word, t.form, c.root, t.n, t.n_near, t.form_n
FROM told t JOIN chain c ON c.word = t.word AND c.up IS NULL
"""
