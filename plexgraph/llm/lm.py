"""Language-model scores of whole texts: a smoothed unigram base and a causal self-attention model on subword ids.

Words are counted over all training texts. Counts of the ``HEAD`` most frequent words at most go to every task; the
rest of a document's words meet their counts in a join by word, as rows that hold no text. Subword frequencies come from
the table of distinct words, each cut once, so they too cover the corpus.

The model is fitted in two steps, for which each training text of any length is cut in stretches of ``STRETCH`` characters.
One task fits starting weights to at most ``SAMPLE`` stretches. Then the model learns from all stretches, each whole and in one of
``ROUNDS`` passes: every task takes steps from the common model over its own stretches, and the models are averaged by their
windows. So all training text teaches the model, and long texts count by their length. Every text is scored whole.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.llm import attention
from plexgraph.llm.common import BATCH_BYTES, bounded_batches, settled

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
HEAD, SAMPLE = 200_000, 1_500
#: Characters of a stretch and of the piece of it that is learned from, which is all of it; passes over them and their rate.
STRETCH, PIECE, ROUNDS, RATE = 1 << 14, 1 << 14, 2, 2e-3
#: Models that meet in the driver after a pass, and pieces that a task learns from at a time.
_MEET, _GROUP = 32, 256
#: Words whose subword ids a worker holds at a time.
_CACHE = 50_000
#: Bytes of text whose words are counted at a time, if there is more than one batch.
_COUNTED = 4 * BATCH_BYTES
#: The table's row for the end of a text; no word is empty.
_END = b""
#: A longer word is cut in pieces of so many bytes before its subwords are looked up.
_PIECE = 200
_END_LEAF = np.int16(attention.END).tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def column_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``words_of`` for a column: its distinct words, the place of each word of each text among them, and the texts' numbers of words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = split.flatten(), split.offsets.to_numpy()
    real = pc.binary_length(words).to_numpy() > 0  # a text that begins or ends with white space has an empty part there
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]])
    found = (words if real.all() else words.filter(pa.array(real))).dictionary_encode()
    return found.dictionary.cast(pa.binary()), found.indices.to_numpy(), counts


class Subwords:
    """Subword ids of words, by a public tokenizer's ranks."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._bpe = tiktoken.Encoding("own", pat_str=r" [^ ]+", mergeable_ranks=table, special_tokens={})._core_bpe
        self._begins = np.zeros(1 + max(table.values()), bool)
        self._begins[[i for t, i in table.items() if t.startswith(b" ")]] = True

    def ids(self, word: bytes) -> list[int]:
        if len(word) < _PIECE:
            return self._bpe.encode_single_piece(b" " + word)
        return [i for a in range(0, len(word), _PIECE) for i in self._bpe.encode_single_piece((b"" if a else b" ") + word[a : a + _PIECE])]

    def cut(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of all words of an array, one after the other, and each word's number of them.

        Short words are cut in one call, each with a space before it; only the first subword of a word begins with a space.
        """
        length = pc.binary_length(words).to_numpy()
        long, some = length >= _PIECE, (length > 0) & (length < _PIECE)  # the empty word has no subwords
        short = words if some.all() else words.filter(pa.array(some))
        sizes, ids = np.zeros(len(words), np.int64), np.zeros(0, np.int32)
        if len(short):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), short), b" ")[0].as_py()
            ids = np.array(self._bpe.encode_ordinary((b" " + joined).decode()), np.int32)
            sizes[some] = np.diff(np.flatnonzero(self._begins[ids]), append=len(ids))
        if long.any():
            cut = [self.ids(w) for w in words.filter(pa.array(long)).to_pylist()]
            sizes[long] = [len(c) for c in cut]
            apart, out = np.repeat(long, sizes), np.empty(sizes.sum(), np.int32)
            out[~apart], out[apart] = ids, np.concatenate(cut)
            ids = out
        return ids, sizes


_held: dict = {}


def _subwords(ranks: Broadcast) -> Subwords:
    if "subwords" not in _held or _held["ranks"] != ranks.value:
        _held.update(ranks=ranks.value, subwords=Subwords(ranks.value))
    return _held["subwords"]


class Leaves(dict):
    """word -> its leaves as bytes; ``rest`` has the log10 of what its subwords add inside shared leaves.

    Words of ``keep`` stay; of the others about ``_CACHE`` at most are held.
    """

    def __init__(self, subwords: Subwords, leaf: np.ndarray, inside: np.ndarray, keep: Container[bytes] = ()):
        super().__init__()
        self._ids, self._keep, self._rare, self.rest = subwords.ids, keep, [], {}
        self._leaf = [x.tobytes() for x in leaf.astype(np.int16)]
        self._inside = {int(i): float(inside[i]) for i in np.flatnonzero(inside)}

    def __missing__(self, word: bytes) -> bytes:
        ids = self._ids(word)
        self[word] = out = b"".join([self._leaf[i] for i in ids])
        if not self._inside.keys().isdisjoint(ids):
            self.rest[word] = sum(self._inside.get(i, 0.0) for i in ids)
        if word not in self._keep:
            self._rare.append(word)
        return out

    def _evict(self) -> None:
        for w in self._rare:
            self.pop(w, None)
            self.rest.pop(w, None)
        self._rare.clear()

    def sequence(self, words: list[bytes]) -> tuple[np.ndarray, float]:
        """Leaves of a text with the end, and the log10 probability of its subwords given their leaves."""
        parts, extra = [], 0.0
        for a in range(0, len(words), 4096):
            piece = words[a : a + 4096]
            parts += map(self.__getitem__, piece)
            extra += sum(map(self.rest.get, piece, repeat(0.0)))
            if len(self._rare) > _CACHE:
                self._evict()
        parts.append(_END_LEAF)
        return np.frombuffer(b"".join(parts), dtype=np.int16), extra


class Sequences:
    """Leaves of the texts of a column, as by ``Leaves.sequence``; each distinct word of the column is cut once.

    ``words`` are the distinct words and, as the last, the end; ``at`` is the place among them of each token of each text, where a
    text's tokens begin at ``first``; ``extra`` has the log10 of what the texts' subwords add inside shared leaves.
    """

    def __init__(self, texts: pa.Array, subwords: Subwords, leaf: np.ndarray, inside: np.ndarray):
        words, at, counts = column_words(texts)
        self.words, self.n_tokens = pa.concat_arrays([words, pa.array([_END], pa.binary())]), counts + 1
        last = np.cumsum(self.n_tokens) - 1
        self.first = last - counts
        self.at = np.full(len(at) + len(counts), len(words), np.int32)
        inner = np.ones(len(self.at), bool)
        inner[last] = False
        self.at[inner] = at
        ids, sizes = subwords.cut(words)
        begin = np.cumsum(sizes) - sizes
        self.extra = self.sums(np.append(np.add.reduceat(inside[ids], begin) if len(ids) else [], 0.0))
        # Each token's leaves stand together among those of the distinct words.
        cut, begin, sizes = np.append(leaf[ids], attention.END).astype(np.int16), np.append(begin, len(ids)).astype(np.int32), np.append(sizes, 1).astype(np.int32)
        each = sizes[self.at]
        stop = np.cumsum(each)
        source = np.repeat(begin[self.at] - (stop - each).astype(np.int32), each)
        source += np.arange(len(source), dtype=np.int32)
        leaves, ends = cut[source], stop[last].tolist()
        self.leaves = [leaves[a:b] for a, b in zip([0, *ends], ends)]

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        """Sums over each text's tokens of what its words have."""
        return np.add.reduceat(of_words[self.at], self.first)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    for b in batches:
        if held and sum(x.nbytes for x in held) + b.nbytes > _COUNTED:
            yield _pairs(held)
            held = []
        held.append(b.column(0))
    if held:
        yield _pairs(held)


def _pairs(texts: list[pa.Array]) -> pa.RecordBatch:
    words, at, sizes = column_words(pa.concat_arrays(texts))
    n = np.append(np.bincount(at, minlength=len(words)), len(sizes))
    return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([_END], pa.binary())]), pa.array(n, pa.int64())], names=["word", "n"])


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; the empty word stands for the end of a text."""
    bounded_batches(texts.sparkSession)
    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _count_subwords(batches: Iterable[pa.RecordBatch], ranks: Broadcast) -> Iterator[pa.RecordBatch]:
    subwords, counts = _subwords(ranks), np.zeros(0, np.int64)
    for b in batches:
        ids, sizes = subwords.cut(b.column(0))
        here = np.zeros(max(len(counts), ids.max(initial=-1) + 1), np.int64)
        here[: len(counts)] = counts
        np.add.at(here, ids, np.repeat(b.column(1).to_numpy(), sizes))
        counts = here
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], names=["id", "n"])


def head_of(counts: DataFrame, most: int = HEAD) -> dict[bytes, int]:
    """The words that occur at least so often that no more than ``most`` do."""
    left, least = most, None
    for n, words in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if words > left:
            break
        left, least = left - words, n
    if least is None:
        return {}
    found = counts.where(F.col("n") >= least).toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))


def leaves(frequency: dict[int, int], ends: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of each subword id, log10 probability of the id in its leaf, and the leaves' frequencies.

    Frequent subwords have a leaf of their own; the others share ``FAN`` leaves of about equal weight.
    """
    order = sorted(frequency, key=lambda i: (-frequency[i], i))
    own = attention.LEAVES - attention.FAN - 1
    leaf = np.full(vocabulary, attention.LEAVES - 1, np.int16)
    leaf[order[:own]] = np.arange(1, len(order[:own]) + 1)
    tail = order[own:]
    if tail:
        run = np.cumsum([frequency[i] for i in tail], dtype=float)
        leaf[tail] = attention.LEAVES - attention.FAN + np.minimum(attention.FAN - 1, (run / run[-1] * attention.FAN).astype(int))
    n = np.zeros(vocabulary)
    n[list(frequency)] = list(frequency.values())
    shared = leaf >= attention.LEAVES - attention.FAN
    n[shared] += 0.5
    mass = np.bincount(leaf, weights=n, minlength=attention.LEAVES)
    inside = np.zeros(vocabulary)
    inside[shared] = np.log10(n[shared] / mass[leaf[shared]])
    mass[attention.END] = ends
    return leaf, inside, mass


def fit(texts: list[str], subwords: Subwords, frequency: dict[int, int], ends: int, vocabulary: int = 50_256) -> dict:
    """A model of leaves, as arrays, from a sample of texts and the corpus's subword frequencies."""
    leaf, inside, mass = leaves(frequency, ends, vocabulary)
    table = Leaves(subwords, leaf, inside)
    sample = [table.sequence(words_of(t))[0] for t in texts]
    follows = np.zeros((attention.LEAVES, attention.LEAVES), np.float32)
    for s in sample:
        np.add.at(follows, (np.concatenate([[attention.END], s[:-1]]), s), 1)
    order = attention.tree_order(follows)
    place = np.empty(attention.LEAVES, np.int16)
    place[order] = np.arange(attention.LEAVES)
    first = int(order[0])  # the end stays leaf 0
    place[first], place[attention.END] = place[attention.END], 0
    placed = np.zeros_like(mass)
    placed[place] = mass
    return {"leaf": place[leaf], "inside": inside, "parameters": attention.train([place[s] for s in sample], placed)}


def _fit(batches: Iterable[pa.RecordBatch], ranks: Broadcast, frequency: dict[int, int], ends: int, vocabulary: int) -> Iterator[pa.RecordBatch]:
    texts = [t for b in batches for t in b.column(0).to_pylist()]
    model = fit(texts, _subwords(ranks), frequency, ends, vocabulary)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def piece_of(stretch: str, h: int) -> str:
    """A piece of a stretch, which begins at a place that its hash decides; a word that the piece begins or ends in is left out."""
    if len(stretch) <= PIECE:
        return stretch
    a = (h >> 8) % (len(stretch) - PIECE + 1)
    piece = stretch[a : a + PIECE]
    piece = piece.partition(" ")[2] if a else piece
    return piece if a + PIECE == len(stretch) else piece.rpartition(" ")[0]


def pieces(training: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, stretch) of all stretches of all texts: h is a hash of the id, the text and the stretch's number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = training.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), text.alias("text"), F.posexplode(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / STRETCH).cast("int"))).alias("pos", "k"))
    return each.select(F.xxhash64("key", "k").alias("h"), F.substring(F.col("text"), F.col("k") * STRETCH + 1, F.lit(STRETCH)).alias("stretch"))


def _refine(batches: Iterable[pa.RecordBatch], model: Broadcast, ranks: Broadcast, rate: float) -> Iterator[pa.RecordBatch]:
    m, subwords = model.value, _subwords(ranks)

    def groups() -> Iterator[list[np.ndarray]]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1)
            if PIECE < STRETCH:
                texts = pa.array([piece_of(t, h) for h, t in zip(b.column(0).to_pylist(), texts.to_pylist())], pa.string())
            held += Sequences(texts, subwords, m["leaf"], m["inside"]).leaves
            while len(held) >= _GROUP:
                yield held[:_GROUP]
                held = held[_GROUP:]
        if held:
            yield held

    p, n = attention.refine(m["parameters"], groups(), rate)
    if n:
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task % _MEET], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())], names=["meet", "n", "model"])


def _averaged(rows: Iterable[tuple[int, bytes]]) -> tuple[dict, int]:
    total, out = 0, {}
    for n, raw in rows:
        for k, x in pickle.loads(raw).items():
            out[k] = out[k] + x.astype(np.float64) * n if k in out else x.astype(np.float64) * n
        total += n
    return {k: (x / total).astype(np.float32) for k, x in out.items()}, total


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, n = _averaged((n, raw) for b in batches for n, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())], names=["meet", "n", "model"])


def refined(model: dict, drawn: DataFrame, ranks: Broadcast) -> dict:
    """The model after ``ROUNDS`` averaged passes over the drawn (h, stretch), each row in one of them."""
    spark, schema = drawn.sparkSession, "meet int, n long, model binary"
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        mine = drawn.where(F.pmod(F.shiftright("h", 4), F.lit(ROUNDS)) == k).select("h", "stretch")
        learned = mine.mapInArrow(partial(_refine, model=sent, ranks=ranks, rate=RATE / (k + 1)), schema)
        p, n = _averaged((r["n"], r["model"]) for r in learned.repartition(_MEET, "meet").mapInArrow(_meet, schema).toLocalIterator())
        model = model | {"parameters": p} if n else model
        sent.unpersist()
    return model


_ROWS = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, score double, tail array<binary>"


def _score(batches: Iterable[pa.RecordBatch], head: Broadcast, model: Broadcast, ranks: Broadcast) -> Iterator[pa.RecordBatch]:
    (often, logs), m, subwords = head.value, model.value, _subwords(ranks)
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        if not b.num_rows:
            continue
        found = Sequences(b.column(1), subwords, m["leaf"], m["inside"])
        n = b.num_rows
        of_words = logs[pc.fill_null(pc.index_in(found.words, value_set=often), -1).to_numpy()]  # no count of a known word is 0
        known = found.sums((of_words > 0).astype(np.int64))
        rare = pa.array(found.at[of_words[found.at] == 0])
        tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.n_tokens - known)]), pa.int32()), found.words.take(rare))
        scores = attention.scores(m["parameters"], found.leaves) / math.log(10) + found.extra
        rows = np.arange(row, row + n)
        row += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), b.column(0), b.column(2), pa.array(found.n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(found.sums(of_words), pa.float64()), pa.array(scores, pa.float64()), tails],
            names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "score", "tail"],
        )


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Learns from the rows where ``learn`` holds. Tokens are the words of the text with A-Z lowered and one end; a null
    text is empty. ``score`` is the model's log10 probability of these words, cut into subwords, and of the end. Without
    training rows every count is 0 and the model is that of its starting weights. Repeated rows are scored each time; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    training = docs.where(learn)
    counts = settled(word_counts(training, text_col))
    total, kinds, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(_END), F.col("n"))), F.lit(0))).first()
    with open(tokenizer, "rb") as f:
        raw = f.read()
    ranks = spark.sparkContext.broadcast(raw)
    subword_counts = counts.mapInArrow(partial(_count_subwords, ranks=ranks), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    frequency = {i: n for i, n in subword_counts.toLocalIterator()}  # no more rows than the tokenizer has ids
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    drawn = pieces(training, id_col, text_col)
    vocabulary = len(raw.splitlines())
    # About 2 * SAMPLE stretches of texts pass, however many there are, so what meets in one task doesn't grow with the input.
    last = min(2**64, 2**65 * SAMPLE // max(1, ends)) - 2**63 - 1
    # A task, as Python workers compute with one thread; many threads on such small matrices wait for each other.
    sample = drawn.where(F.col("h") <= last).orderBy("h", "stretch").limit(SAMPLE).select("stretch")
    fitted = sample.mapInArrow(partial(_fit, ranks=ranks, frequency=frequency, ends=ends, vocabulary=vocabulary), "model binary").first()
    if fitted:
        model = spark.sparkContext.broadcast(refined(pickle.loads(fitted[0]), drawn, ranks))
    else:
        model = spark.sparkContext.broadcast(fit([], Subwords(raw), frequency, ends, vocabulary))
    often = head_of(counts)
    # For words that aren't among them, a 0 at the end.
    head = spark.sparkContext.broadcast((pa.array(list(often), pa.binary()), np.append(np.log10(np.array(list(often.values()), float) + 1), 0.0)))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(~learn, F.lit(False)).alias("held_out"))
    rows = settled(slim.mapInArrow(partial(_score, head=head, model=model, ranks=ranks), _ROWS))
    rare = rows.select("row", F.explode("tail").alias("word")).join(counts, "word")
    tails = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("tail_sum"), F.count(F.lit(1)).alias("tail_known"))
    out = rows.drop("tail").join(tails, "row", "left")
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + kinds + 1)
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
