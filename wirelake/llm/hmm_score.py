"""Language-model scores from a hidden Markov model.

Tokens are the lower-cased (A-Z) words of a text and one end. The tokens of blocks of documents become numbers of the block's own
vocabulary; only vocabularies are shuffled, to count every word over the whole training part of the corpus.

Model: ``STATES`` latent states with transitions A emit token classes with probabilities B; a token has a fixed share of its class.
The ``TOP`` most frequent words are classes of their own, all others share classes by their ending, and a word that training never saw is the
class of unknown words, whose mass in each state and after each round is that of words seen once. So the parameters have a fixed size, every word counts, and
the probabilities of all token sequences sum to one.

Training: the classes' co-occurrence in documents (a fixed-size matrix summed over the corpus) groups the frequent classes; each group starts a
state. Then ``ROUNDS`` rounds of Baum-Welch: every task runs scaled forward and backward recursions over its documents and
sends one row of expected counts for each class and state; Spark adds them up; the driver normalises. Scoring: the scaled forward recursion
gives each text's exact likelihood.

Edge cases: a null text is empty and has one token, the end; null ids are learned from if the crc32 of the empty text allows it; repeated rows count and
are answered each; without training documents all tokens are unknown and every score is zero; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_stash, slices, stash, table, text_bytes

STATES, TOP, ENDINGS, ROUNDS, BLOCK_TOKENS, SEED_CLASSES = 8, 1536, 1024, 2, 3_000_000, 256
CLASSES = TOP + ENDINGS + 1
UNKNOWN = CLASSES - 1
FOLDS, HELD = 7, 2
PSEUDO, STAY = 100.0, 0.9
#: Tokens whose forward variables are held at a time.
ROOM = 1_000_000

BLOCKS = "block long, ids array<long>, lens array<int>, train array<boolean>, tokens binary, words array<binary>, seen array<long>"
SEQUENCES = "block long, ids array<long>, lens array<int>, train array<boolean>, classes binary, known array<int>, base array<double>, lexical array<double>"


def _squeeze(numbers: np.ndarray) -> bytes:
    """Small non-negative numbers as compressed planes of their bytes."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _swell(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _intern(batches):
    """Documents (id, text, train) to blocks with their own vocabularies."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    vocab: dict[bytes, int] = {}
    ids, lens, train, tokens, size = [], [], [], [], 0

    def out():
        nonlocal vocab, ids, lens, train, tokens, size, seq
        flat = np.concatenate(tokens)
        often = np.argsort(-np.bincount(flat, minlength=len(vocab)), kind="stable")  # frequent words get small numbers
        number = np.empty_like(often)
        number[often] = np.arange(len(often))
        words = list(vocab)
        learned = np.repeat(np.array(train), np.array(lens))
        seen = np.bincount(flat[learned], minlength=len(vocab))[often]
        cols = [[part << 24 | seq], [ids], [lens], [train], [_squeeze(number[flat])], [[words[i] for i in often.tolist()]], [seen]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        b = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])
        vocab, ids, lens, train, tokens, size, seq = {}, [], [], [], [], 0, seq + 1
        return b

    for batch in slices(batches):
        for i, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = t.lower().split()
            words.append(b"")  # the end: no word is empty
            for w in set(words).difference(vocab):
                vocab[w] = len(vocab)
            tokens.append(np.array([vocab[w] for w in words], np.int32))
            ids.append(i)
            lens.append(len(words))
            train.append(y)
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield out()
    if ids:
        yield out()


@dataclass
class Lexicon:
    total: int  # tokens learned from
    types: int
    once: int
    mass: np.ndarray  # learned tokens of each class
    rare: np.ndarray  # words seen once of each class


def _sequencer(lex: Lexicon):
    """A block and its vocabulary's counts to class sequences and the parts of the scores that need no state."""
    names = [f.split()[0] for f in SEQUENCES.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def run(block: pa.Table, vocab: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        lens = np.array(r["lens"])
        local, cls, c = (vocab.column(k).to_numpy() for k in ("local", "cls", "c"))
        count, kind = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        count[local], kind[local] = c, np.where(c > 0, cls, UNKNOWN)
        flat = _swell(r["tokens"])
        at = np.concatenate(([0], np.cumsum(lens)[:-1]))
        base = np.log10(count + 1.0) - math.log10(lex.total + lex.types + 1)
        share = np.where(count > 0, np.log(np.maximum(count, 1) / np.maximum(lex.mass[kind], 1)), 0.0)
        cols = [[r["block"]], [r["ids"]], [r["lens"]], [r["train"]], [_squeeze(kind[flat])], *([np.add.reduceat(x[flat], at)] for x in ((count > 0).astype(np.int32), base, share))]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes


class Steps:
    """Sequences laid out by time: those that last longest first, so that the ones that go on are always the first rows."""

    def __init__(self, classes: np.ndarray, lens: np.ndarray):
        self.order = np.argsort(-lens, kind="stable")
        lens_, at = lens[self.order], np.concatenate(([0], np.cumsum(lens)[:-1]))[self.order]
        first = np.repeat(at - np.concatenate(([0], np.cumsum(lens_)[:-1])), lens_)
        place = np.arange(lens.sum())
        time = place - np.repeat(np.concatenate(([0], np.cumsum(lens_)[:-1])), lens_)
        self.classes = classes[(place + first)[np.argsort(time, kind="stable")]].astype(np.int64)
        self.active = np.bincount(time) if len(time) else np.zeros(0, int)
        self.at = np.concatenate(([0], np.cumsum(self.active)))

    def forward(self, model: Model) -> np.ndarray:
        """Log-likelihoods in the order of the input."""
        emit, like, now = np.ascontiguousarray(model.emit.T), np.zeros(len(self.order)), None
        for t, n in enumerate(self.active):
            a, b = self.at[t], self.at[t + 1]
            now = (model.start if t == 0 else now[:n] @ model.move) * emit[self.classes[a:b]]
            s = now.sum(1)
            now /= s[:, None]
            like[:n] += np.log(s)
        out = np.empty_like(like)
        out[self.order] = like
        return out

    def _cuts(self, room: int) -> list[int]:
        """Times that cut the steps into spans of at most room tokens (or one step)."""
        cuts = [0]
        for t in range(1, len(self.active)):
            if self.at[t + 1] - self.at[cuts[-1]] > room:
                cuts.append(t)
        return [*cuts, len(self.active)]

    def _span(self, model: Model, emit: np.ndarray, now, lo: int, hi: int, keep: bool):
        """The forward variables after the steps from lo up to hi; with keep, those of all its steps and the scales."""
        first = self.at[lo]
        alpha = np.empty((self.at[hi] - first, len(model.start))) if keep else None
        scales = np.empty(self.at[hi] - first) if keep else None
        for t in range(lo, hi):
            a, b = self.at[t], self.at[t + 1]
            now = (model.start if t == 0 else now[: b - a] @ model.move) * emit[self.classes[a:b]]
            s = now.sum(1)
            now /= s[:, None]
            if keep:
                alpha[a - first : b - first], scales[a - first : b - first] = now, s
        return now, alpha, scales

    def expect(self, model: Model, room: int = ROOM):
        """Expected counts of starts, moves and emissions. Forward variables are held for a span of steps at a time, and computed again from the span's first."""
        emit = np.ascontiguousarray(model.emit.T)
        k, classes = len(model.start), model.emit.shape[1]
        start, moves, counts = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
        if not len(self.active):
            return start, moves, counts
        cuts = self._cuts(room)
        before = [None]
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            before.append(self._span(model, emit, before[-1], lo, hi, False)[0])
        beta = None  # of the step after, times its emission over its scale
        for lo, hi, now in reversed(list(zip(cuts[:-1], cuts[1:], before, strict=True))):
            _, alpha, scales = self._span(model, emit, now, lo, hi, True)
            first = self.at[lo]
            for t in range(hi - 1, lo - 1, -1):
                a, b, n = self.at[t] - first, self.at[t + 1] - first, self.active[t]
                new = np.ones((n, k))
                if beta is not None:
                    m = len(beta)
                    moves += alpha[a : a + m].T @ beta
                    new[:m] = beta @ model.move.T
                beta = new * emit[self.classes[self.at[t] : self.at[t + 1]]] / scales[a:b, None]
                alpha[a:b] *= new  # now the posterior
            counts += np.stack([np.bincount(self.classes[first : self.at[hi]], alpha[:, j], classes) for j in range(k)])
            if lo == 0:
                start = alpha[: self.active[0]].sum(0)
        return start, moves * model.move, counts


def _pieces(block, pick: np.ndarray, size: int = 400_000):
    """(documents, their Steps) for the chosen documents of a block, a bounded number of tokens at a time (or one document)."""
    lens = np.array(block["lens"])
    ends = np.cumsum(lens)
    classes = _swell(block["classes"])
    # alike lengths together: few documents go on alone
    pick = pick[np.argsort(lens[pick], kind="stable")]
    group = np.cumsum(lens[pick]) // size
    for g in np.unique(group):
        docs = pick[group == g]
        yield docs, Steps(np.concatenate([classes[ends[d] - lens[d] : ends[d]] for d in docs]), lens[docs])


def _counter(share):
    def run(batches):
        model = share.value
        k = len(model.start)
        start, moves, counts = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES))
        for b in slices(batches, 1):
            block = b.to_pylist()[0]
            for _, steps in _pieces(block, np.flatnonzero(block["train"])):
                s, m, c = steps.expect(model)
                start, moves, counts = start + s, moves + m, counts + c
        rows = np.concatenate((counts.T, moves, start[None]))
        yield pa.record_batch([pa.array(np.arange(len(rows)), pa.int32()), *(pa.array(rows[:, j]) for j in range(k))], names=["row", *(f"s{j}" for j in range(k))])

    return run


def _together(batches):
    """Co-occurrence of the first classes in training documents, as shares."""
    out = np.zeros((SEED_CLASSES, SEED_CLASSES))
    for b in slices(batches, 1):
        r = b.to_pylist()[0]
        lens, train = np.array(r["lens"]), np.array(r["train"], bool)
        classes = _swell(r["classes"])
        doc = np.repeat(np.arange(len(lens)), lens)
        use = (classes < SEED_CLASSES) & train[doc]
        for lo in range(0, len(lens), 2000):
            here = use & (doc >= lo) & (doc < lo + 2000)
            x = np.bincount((doc[here] - lo) * SEED_CLASSES + classes[here], minlength=2000 * SEED_CLASSES).reshape(2000, SEED_CLASSES)
            x = np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))
            out += x.T @ x
    yield pa.record_batch([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], names=["cell", "v"])


def _groups(together: np.ndarray, k: int) -> np.ndarray:
    """Classes grouped by what they occur with: k-means on the rows' directions, started from the farthest points."""
    norm = np.sqrt(np.maximum(np.diag(together), 1e-12))
    x = together / norm[:, None] / norm[None]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x[0]]
    for _ in range(k - 1):
        far = np.min([1 - x @ c for c in centres], 0)
        centres.append(x[int(np.argmax(far * (np.diag(together) > 0)))])
    c = np.stack(centres)
    label = np.zeros(len(x), int)
    for _ in range(30):
        label = np.argmax(x @ c.T, 1)
        for j in range(k):
            if (label == j).any():
                m = x[label == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return label


def _normal(start, moves, counts, prior) -> Model:
    emit = counts + PSEUDO * prior
    moves, start = moves + 1.0, start + 1.0
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _sum_rows(df: DataFrame, key: str, n: int, width: list[str]) -> np.ndarray:
    out = np.zeros((n, len(width)))
    for r in df.groupBy(key).agg(*[F.sum(c).alias(c) for c in width]).collect():  # n rows at most
        out[r[0]] = r[1:]
    return out


def train(sequences: DataFrame, lex: Lexicon, rounds: int = ROUNDS, states: int = STATES) -> Model:
    sc = sequences.sparkSession.sparkContext
    prior = lex.mass.astype(float).copy()
    prior[UNKNOWN] = lex.once + 1
    prior /= prior.sum()
    cells = _sum_rows(sequences.mapInArrow(_together, "cell int, v double"), "cell", SEED_CLASSES**2, ["v"])
    label = _groups(cells.reshape(SEED_CLASSES, SEED_CLASSES), states)
    emit = np.tile(prior, (states, 1))
    for s in range(states):
        emit[s, :SEED_CLASSES] *= np.where(label == s, 1.0, 0.05)
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY)
    model = _normal(np.ones(states), move * 1000, emit / emit.sum(1, keepdims=True) * lex.total, prior)
    for _ in range(rounds):
        share = sc.broadcast(model)  # states x classes, whatever the corpus
        names = [f"s{j}" for j in range(states)]
        rows = _sum_rows(sequences.mapInArrow(_counter(share), "row int, " + ", ".join(f"{n} double" for n in names)), "row", CLASSES + states + 1, names)
        counts = rows[:CLASSES].T.copy()
        # no training sequence holds UNKNOWN: a state gets as many as it is expected to emit words seen once
        counts[:, UNKNOWN] = counts @ (lex.rare / np.maximum(lex.mass, 1))
        model = _normal(rows[-1], rows[CLASSES:-1], counts, prior)
    return model


def prepare(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, Lexicon]:
    """Class sequences of all documents, written to the shared folder, and the counts behind them."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text).alias("t"), (crc_mod(id_col, FOLDS) != HELD).alias("train"))
    blocks = stash(plain.mapInArrow(_intern, BLOCKS), "hmm-blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "seen")).alias("local", "w"))
    words = words.select("block", "local", F.col("w.words").alias("word"), F.col("w.seen").alias("n"))
    # a word has at most one row for each block, however often it occurs
    ending = F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int") + TOP
    counted = words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    types = stash(counted.select("word", F.xxhash64("word").alias("wh"), ending.alias("ending"), "c"), "hmm-words")
    total, kinds, once = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    top = types.orderBy(F.desc("c"), "wh").limit(TOP).select("wh", "c").collect()  # TOP rows at most
    spark = docs.sparkSession
    rank = spark.createDataFrame([(r.wh, i) for i, r in enumerate(top)], "wh long, rank int")
    classed = types.join(F.broadcast(rank), "wh", "left").select("word", F.coalesce("rank", "ending").alias("cls"), "c")
    mass, rare = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in classed.groupBy("cls").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect():  # CLASSES rows at most
        mass[r.cls], rare[r.cls] = r.c, r.once
    lex = Lexicon(int(total), int(kinds), int(once), mass, rare)
    # a common word's blocks may be many: a shuffled join whose skewed partitions AQE splits
    each = words.select("block", "local", "word").join(classed.hint("merge"), "word", "left")
    each = stash(each.select(F.col("block").alias("of"), "local", F.coalesce("cls", F.lit(UNKNOWN)).alias("cls"), F.coalesce("c", F.lit(0)).alias("c")), "hmm-classed", "zstd")
    by_block = each.groupBy("of")  # a block's size is bounded
    sequences = blocks.drop("words", "seen").groupBy("block").cogroup(by_block).applyInArrow(_sequencer(lex), SEQUENCES)
    sequences = stash(sequences, "hmm-sequences")
    for t in (blocks, types, each):
        drop_stash(t)
    return sequences, lex


def score(sequences: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    share = sequences.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for b in slices(batches, 1):
            r = b.to_pylist()[0]
            lens = np.array(r["lens"])
            like = np.zeros(len(lens))
            for docs, steps in _pieces(r, np.arange(len(lens))):
                like[docs] = steps.forward(share.value)
            total = (like + np.array(r["lexical"])) / math.log(10)
            cols = [pa.array(r["ids"], pa.int64()), pa.array([not x for x in r["train"]]), pa.array(lens, pa.int64()), pa.array(r["known"], pa.int64()), pa.array([lex.total] * len(lens), pa.int64()), pa.array(r["base"], pa.float64()), pa.array(total)]
            yield pa.record_batch(cols, names=names)

    return sequences.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences, lex = prepare(table(spark, sf_dir, "documents"))
    return score(sequences, lex, train(sequences, lex))
