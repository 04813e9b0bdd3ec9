"""LM scoring by logistic context mixing.

The model predicts a text bit by bit: its words, lower-cased, each followed by a space, and a line end after the last.
Five predictors look up how often the bit was 0 and 1 in a hashed context (the bytes of the word so far, and its last
one to four bytes; with the bits of the current byte). Their log odds are combined by weights chosen by the bit's place and by
how much the two longest contexts have seen, learned online by gradient steps, and a map from the mixed odds to what really came, learned
alongside, refines them.

A word's bits are mixed once more with its own share of the training words, and since documents keep to a language,
words are weighed by a mixture over language classes. Every step keeps a proper distribution over words.

All contexts lie within a word, so a word's probability doesn't depend on its neighbours, and all work on the corpus is
work on its distinct words: counting them is one aggregation; the predictors' counts are sums over them, added up over
the tasks; then weights are learned in blocks of about ``LEARNER`` words that a hash of the word decides, each in order of
its words, predicting each word as if one occurrence of it were not counted, and the blocks' weights are averaged. So scores
don't depend on how many tasks share the work. Texts look their frequent words up in a broadcast table (words with at
least one in 2**20 of the training tokens, so 2**20 at most) and their rare ones by a join.

Words are modelled in pieces of at most ``PIECE`` bytes, each coded like a word, so that a text without spaces takes
bounded memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut, sliced, text_key

ORDERS = (1, 2, 3, 4, 0)  # bytes of each context; 0: the whole word so far
BITS = (16, 20, 20, 20, 21)  # slots of each predictor
OFFSET = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
GATES = 8 * 36  # by bit of the byte, and by how much the two longest contexts have seen
BUCKETS = 33
HOT = 20
CLASSES = 8  # of documents: the most frequent languages, and all others
UNSURE = 0.5  # occurrences' worth of doubt about a word's class
PRIOR = 0.05  # of either bit in any context
PIECE = 1 << 12
LEARNER = 100_000  # words of a block that learns weights of its own
_BLOCK = 1 << 12  # slots that are summed as one row
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NODES = (np.arange(256, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)


class _Bits:
    """All predictions that some words need: for each bit its predictors' slots, the bit, and the word it belongs to."""

    def __init__(self, words: list[bytes]):
        buf = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        n = len(buf)
        size = np.array([len(w) + 1 for w in words])
        word = np.repeat(np.arange(len(words)), size)
        begin = np.repeat(np.cumsum(size) - size, size)
        inner = np.arange(n) - begin
        hashes = []
        back = [np.where(inner >= k, np.roll(buf, k), 32).astype(np.uint64) for k in range(1, 5)]
        for order in ORDERS:
            h = np.full(n, np.uint64(order * 77 + 5), np.uint64)
            if order:
                for k in range(order):
                    h = (h + back[k] + np.uint64(1)) * _MULT
                    h ^= h >> np.uint64(29)
            else:
                powers = np.ones(int(size.max()), np.uint64)
                powers[1:] = np.uint64(0xD6E8FEB86659FD93)
                powers = np.multiply.accumulate(powers)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[inner], dtype=np.uint64)))
                h = (total[:-1] - total[begin]) * _MULT + inner.astype(np.uint64)
                h ^= h >> np.uint64(31)
            hashes.append((h * _MULT >> np.uint64(32)).astype(np.uint32))
        self.slots = [np.empty((8, n), np.int32) for _ in ORDERS]
        self.bit = np.empty((8, n), np.uint8)
        node = np.ones(n, np.uint8)
        for k in range(8):
            at = _NODES[node]
            for i, h in enumerate(hashes):
                self.slots[i][k] = ((h + at) >> np.uint32(32 - BITS[i])).view(np.int32) + np.int32(OFFSET[i])
            self.bit[k] = (buf >> (7 - k)) & 1
            node = node << 1 | self.bit[k]
        self.word = word


def _in_pieces(words: list[bytes], limit: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The pieces of ``words``, in groups of about ``limit`` bytes, and the number of the word that each is of."""
    held, of, size = [], [], 0
    for i, w in enumerate(words):
        for k in range(0, max(1, len(w)), PIECE):
            held.append(w[k : k + PIECE])
            of.append(i)
            size += len(held[-1]) + 1
            if size >= limit:
                yield held, np.array(of)
                held, of, size = [], [], 0
    if held:
        yield held, np.array(of)


def _level(seen: np.ndarray) -> np.ndarray:
    """How much a context has seen: 0, 1, 2-3, 4-15, 16-255, more."""
    return (seen > 0.5).astype(np.uint8) + (seen > 1.5) + (seen > 3.5) + (seen > 15.5) + (seen > 255.5)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))


class Model:
    """Counts of all slots [slot, bit], mixing weights [gate, predictor] and refinement map [gate, bucket] of added odds."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, refine: np.ndarray):
        self.counts, self.weights, self.refine = counts, weights, refine
        self.moments: list[np.ndarray] | None = None
        self.looked_up: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"looked_up": None}

    def inputs(self, bits: _Bits, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds of the predictors for bit ``k`` of every byte, and the gates."""
        if self.looked_up is None:
            self.looked_up = _stretch(self.counts[:, 0], self.counts[:, 1]), _level(self.counts.sum(axis=1))
        odds, level = self.looked_up
        return [odds[s[k]] for s in bits.slots], level[bits.slots[3][k]] * np.int16(6) + level[bits.slots[4][k]] + np.int16(36 * k)

    def inputs_without_own(self, bits: _Bits, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The same, as if the words were counted once less."""
        b = bits.bit[k]
        st, level = [], []
        for i, slots in enumerate(bits.slots):
            n = self.counts[slots[k]]
            n0, n1 = np.maximum(n[:, 0] - (b ^ 1), 0), np.maximum(n[:, 1] - b, 0)
            st.append(_stretch(n0, n1))
            if i >= 3:
                level.append(_level(n0 + n1))
        return st, level[0] * np.int16(6) + level[1] + np.int16(36 * k)

    def mixed(self, st: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        return np.clip(sum(w[:, i][gate] * x for i, x in enumerate(st)), -12, 12)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        at = (z + np.float32(12)) * np.float32((BUCKETS - 1) / 24)
        low = np.minimum(at.astype(np.int32), BUCKETS - 2)
        part = at - low
        cell = gate * np.int32(BUCKETS) + low
        flat = self.refine.astype(np.float32).ravel()
        return z + flat[cell] * (1 - part) + flat[cell + 1] * part

    def learn(self, bits: _Bits, times: np.ndarray, rate: float) -> None:
        """An online step for the weights, then one for the map, from each bit position's predictions (Adam, since gradients of rare surprises are huge)."""
        if self.moments is None:
            self.moments = [np.zeros_like(x) for x in (self.weights, self.weights, self.refine, self.refine)]
        mean_w, square_w, mean_r, square_r = self.moments
        n = times[bits.word]
        for k in range(8):
            st, gate = self.inputs_without_own(bits, k)
            b, own = bits.bit[k], slice(36 * k, 36 * k + 36)
            z = self.mixed(st, gate)
            err = n * (b - 1 / (1 + np.exp(-z)))
            mass = np.bincount(gate, n, minlength=GATES)[own, None] + 1
            slope = np.stack([np.bincount(gate, err * x, minlength=GATES)[own] for x in st], axis=1) / mass
            err = n * (b - 1 / (1 + np.exp(-self.refined(z, gate))))
            cell = gate.astype(np.int64) * BUCKETS + np.rint((z + 12) * (BUCKETS - 1) / 24).astype(np.int64)
            up, down = (np.bincount(cell, x, minlength=GATES * BUCKETS).reshape(GATES, BUCKETS)[own] for x in (err, n))
            self.weights[own] += rate * self._step(mean_w[own], square_w[own], slope)
            self.refine[own] += rate * self._step(mean_r[own], square_r[own], up / (down + 20))

    @staticmethod
    def _step(mean: np.ndarray, square: np.ndarray, slope: np.ndarray) -> np.ndarray:
        mean += 0.2 * (slope - mean)
        square += 0.02 * (slope**2 - square)
        return mean / (np.sqrt(square) + 1e-4)

    def score(self, words: list[bytes], limit: int = 1 << 17) -> np.ndarray:
        """log10 probability of every word and the space after it."""
        out = np.zeros(len(words))
        for pieces, of in _in_pieces(words, limit):
            bits = _Bits(pieces)
            total = np.zeros(len(bits.word))
            for k in range(8):
                st, gate = self.inputs(bits, k)
                z = np.clip(self.refined(self.mixed(st, gate), gate), -15, 15)
                z = np.where(bits.bit[k], -z, z)
                total -= np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
            out += np.bincount(of[bits.word], total, minlength=len(words))
        return out / np.log(10)


def count_words(docs: DataFrame, held_out_of: int = 10, languages: tuple[str, ...] = (), *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(word, n, by_class): how often each word of ``docs`` occurs in training documents (crc32 of doc_id as text, modulo ``held_out_of``, isn't 0), in all and by class (the place of the document's language in ``languages``, or the last class); 0 for words of the others alone. The end of a text counts as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught: list[Counter[bytes]] = [Counter() for _ in range(CLASSES)]
        others: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            word = [w for c in taught for w in c] + list(others)
            n = [k for c in taught for k in c.values()] + [0] * len(others)
            kind = [i for i, c in enumerate(taught) for _ in c] + [0] * len(others)
            for c in (*taught, others):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], names=["word", "class", "n"])

        for batch, texts in sliced(batches, "_text"):
            for held, kind, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                words = t.lower().split()
                words.append(b"")
                if held:
                    others.update(words)
                else:
                    taught[kind].update(words)
            if sum(map(len, taught)) + len(others) > 500_000:
                yield flush()
        yield flush()

    kind = F.lit(CLASSES - 1)
    for i, name in enumerate(languages[: CLASSES - 1]):
        kind = F.when(F.col(lang) == name, i).otherwise(kind)
    marked = docs.select(_held_out(doc_id, held_out_of).alias("_held"), kind.alias("_kind"), F.col(text).alias("_text"))
    by_class = F.array(*(F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)) for i in range(CLASSES)))
    return marked.mapInArrow(run, "word binary, class int, n long").groupBy("word").agg(F.sum("n").alias("n"), by_class.alias("by_class"))


def _held_out(doc_id: str, of: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == 0, F.lit(False))


def train(words: DataFrame, *, rate: float = 0.02) -> Model:
    """Fits a model to (word, n). The driver gets the summed counts and averaged weights, whose size is fixed."""
    spark = words.sparkSession
    taught = words.filter("n > 0 and length(word) > 0")
    slots, blocks = int(OFFSET[-1]), int(OFFSET[-1]) // _BLOCK

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * slots)
        for batch, some in sliced(batches, "word", 1 << 17):
            times = batch.column(1).to_numpy().astype(np.float64)
            for pieces, of in _in_pieces(some, 1 << 17):
                bits = _Bits(pieces)
                weight = times[of][bits.word]
                for k in range(8):
                    for s in bits.slots:
                        np.add.at(n, s[k] * 2 + bits.bit[k], weight)
        for b in range(blocks):
            part = n[2 * b * _BLOCK : 2 * (b + 1) * _BLOCK]
            if part.any():
                exact = part.astype(np.float32) if part.max() < 1 << 24 else part
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([exact.tobytes()], pa.binary())], names=["block", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "n"])
                    now, total = b, np.zeros(2 * _BLOCK)
                total += np.frombuffer(x, np.float32 if len(x) == 8 * _BLOCK else np.float64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "n"])

    summed = taught.mapInArrow(counts, "block int, n binary").repartition("block").sortWithinPartitions("block").mapInArrow(added, "block int, n binary")
    table = np.zeros((slots, 2), np.float32)
    for block, raw in cut(summed, "predictors").toLocalIterator():
        table[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(raw).reshape(_BLOCK, 2)
    weights, refine = np.full((GATES, len(ORDERS)), 0.25), np.zeros((GATES, BUCKETS))
    sent = spark.sparkContext.broadcast(table)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model, mass, step = None, None, 0.0, 0

        def done() -> pa.RecordBatch:
            flat = np.concatenate((model.weights.ravel(), model.refine.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * mass), pa.array(np.full(len(flat), mass))], names=["i", "x", "mass"])

        def groups() -> Iterator[tuple[int, list[bytes], list[int]]]:
            # Small groups first, later larger ones; they end where their words do, whatever batches they come in.
            held, times, size, at, limit = [], [], 0, None, 1 << 12
            for batch in batches:
                for who, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if held and (who != at or size >= limit):
                        yield at, held, times
                        held, times, size = [], [], 0
                        limit = 1 << 12 if who != at else min(1 << 15, limit + (1 << 10))
                    at = who
                    held.append(word)
                    times.append(n)
                    size += len(word) + 1
            if held:
                yield at, held, times

        for who, some, times in groups():
            if who != now:
                if model:
                    yield done()
                now, model, mass, step = who, Model(sent.value, weights.copy(), refine.copy()), 0.0, 0
            of_word = np.array(times, np.float64)
            for pieces, of in _in_pieces(some, 1 << 17):
                model.learn(_Bits(pieces), of_word[of], rate / (1 + 0.01 * step))
                step += 1
            mass += float(of_word.sum())
        if model:
            yield done()

    learners = max(8, taught.count() // LEARNER)
    dealt = taught.select(F.pmod(F.xxhash64("word"), F.lit(learners)).alias("learner"), "word", "n").repartition(learners, "learner").sortWithinPartitions("learner", "word")
    means = dealt.mapInArrow(learned, "i int, x double, mass double").groupBy("i").agg((F.sum("x") / F.sum("mass")).alias("x")).collect()  # one row for each weight
    if means:
        flat = np.zeros(weights.size + refine.size)
        for i, x in means:
            flat[i] = x
        weights, refine = flat[: weights.size].reshape(weights.shape), flat[weights.size :].reshape(refine.shape)
    return Model(table, weights, refine)


def score_words(words: DataFrame, model: Model) -> DataFrame:
    """``words`` with score: log10 probability of each word."""
    sent = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in sliced(batches, "word", 1 << 17):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(some))], names=[*batch.schema.names, "score"])

    return words.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in words.dtypes)}, score double")


def mix_words(scored: DataFrame, steps: int = 20) -> DataFrame:
    """``scored`` with the score of the mixture of two word models: the bits' product, and the word's own share of the training words.

    Its weight is the best of ``steps`` when every training word is predicted with one occurrence of it left out (by its
    bits, words that come once depend on the weight alone).
    """
    once = F.greatest(F.col("n") - 1, F.lit(0))
    total = F.sum("n").alias("n")
    grid = [(i + 1) / (steps + 1) for i in range(steps)]
    gain = [F.sum(F.when(F.col("n") > 1, F.col("n") * F.log10(x * once / F.col("_all") + (1 - x) * F.pow(F.lit(10.0), F.col("score")))).otherwise(F.col("n") * float(np.log10(1 - x)))) for x in grid]
    n = scored.agg(F.coalesce(total, F.lit(0))).first()[0]
    if not n:
        return scored
    gains = scored.filter("n > 0").withColumn("_all", F.lit(float(n))).agg(*gain).first()
    x = grid[int(np.argmax(gains))]
    mixed = F.when(F.col("n") > 0, F.log10(x * F.col("n") / float(n) + (1 - x) * F.pow(F.lit(10.0), F.col("score")))).otherwise(F.col("score") + float(np.log10(1 - x)))
    return scored.withColumn("score", mixed)


def score_documents(docs: DataFrame, *, held_out_of: int = 10, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row of ``docs``.

    ``score`` is the model's log10 probability of the words and the end: each word's bits (its space included), the
    chance that the text goes on or ends there, and, since a document keeps to its language, a mixture over classes c of
    the product of P(c|word) / P(c) over its words. The classes are learned from the training documents' languages; the
    language of the document scored isn't looked at. Null texts are empty ones; an empty text is its end alone. Null ids
    are training documents; null languages belong to the last class. Equal rows count as often as they come. With no
    training document all counts are 0.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("l")).count().orderBy(F.desc("count"), "l").limit(CLASSES - 1).collect()
    words = cut(count_words(docs, held_out_of, tuple(r[0] for r in named), doc_id=doc_id, text=text, lang=lang), "word-counts")
    none = lambda c: F.coalesce(c, F.lit(0))
    n_all, n_ends, v, *of_class = words.agg(none(F.sum("n")), none(F.sum(F.when(F.length("word") == 0, F.col("n")))), F.count(F.when(F.col("n") > 0, 1)),
                                            *(none(F.sum(F.when(F.length("word") > 0, F.col("by_class")[i]))) for i in range(CLASSES))).first()
    prior = (np.array(of_class, float) + 0.1) / (sum(of_class) + 0.1 * CLASSES)
    in_class = F.array(*((F.col("by_class")[i] + UNSURE * float(prior[i])) / (F.col("n") + UNSURE) for i in range(CLASSES)))
    scored = cut(score_words(words.filter("length(word) > 0"), train(words)), "word-bits")
    kinds = [f"c{i}" for i in range(CLASSES)]
    mixed = mix_words(scored).withColumn("_in", in_class)
    table = cut(mixed.select("word", "n", F.log10(F.col("n") + 0.1).alias("base"), "score", *(F.log10(F.col("_in")[i]).alias(c) for i, c in enumerate(kinds))), "word-scores")
    # P(c): what the model's words add up to, those not in the table having the prior.
    known, *mass = table.agg(none(F.sum(F.expr("pow(10, score)"))), *(none(F.sum(F.pow(F.lit(10.0), F.col("score") + F.col(c)))) for c in kinds)).first()
    whole = np.log10(np.array(mass) + max(0.0, 1 - known) * prior)
    n_classes = np.log10(prior)
    end = (n_ends + 0.1) / (n_all + 0.2)
    go, stop, norm = np.log10(1 - end), np.log10(end), n_all + 0.1 * (v + 1)
    frequent = F.col("n") * (1 << HOT) >= max(1, n_all)
    hot = table.filter(frequent).select("word", "base", "score", *kinds).collect()  # at most 2**HOT words
    sent = docs.sparkSession.sparkContext.broadcast(({bytes(r[0]): i for i, r in enumerate(hot)}, np.array([r[1:] for r in hot], float).reshape(-1, 2 + CLASSES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        place, values = sent.value
        find = place.get
        for batch, texts in sliced(batches, "_text", 1 << 20):
            at, times, doc, rare_w, rare_n, ends, tokens = [], [], [], [], [], [0], []
            for d, t in enumerate(texts):
                counts = Counter(t.lower().split())
                tokens.append(counts.total())
                begun = len(at)
                for w, k in counts.items():
                    if (i := find(w)) is not None:
                        at.append(i)
                        times.append(k)
                    else:
                        rare_w.append(w)
                        rare_n.append(k)
                doc += [d] * (len(at) - begun)
                ends.append(len(rare_w))
            n = len(texts)
            held, k = values[at].reshape(-1, 2 + CLASSES), np.array(times, float)
            sums = [np.bincount(doc, held[:, i] * k, minlength=n) if len(at) else np.zeros(n) for i in range(2 + CLASSES)]
            found = np.bincount(doc, k, minlength=n) if len(at) else np.zeros(n)
            rows = (part << 40) + row + np.arange(n)
            row += n
            edge = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows), pa.array(tokens, pa.int64()), pa.array(found.astype(np.int64)), pa.array([len(t) for t in texts], pa.int64()),
                 *map(pa.array, sums), pa.ListArray.from_arrays(edge, pa.array(rare_w, pa.binary())), pa.ListArray.from_arrays(edge, pa.array(rare_n, pa.int32()))],
                names=["doc_id", "held_out", "_row", "_words", "_known", "_bytes", *sums_of, "_rare", "_times"])

    sums_of = ["_base", "_score", *(f"_c{i}" for i in range(CLASSES))]
    rows = docs.select(F.col(doc_id).alias("doc_id"), _held_out(doc_id, held_out_of).alias("held_out"), F.col(text).alias("_text"))
    rows = cut(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, _row long, _words long, _known long, _bytes long, {', '.join(f'{c} double' for c in sums_of)}, _rare array<binary>, _times array<int>"), "text-words")
    rare = rows.select(F.col("_row").alias("_r"), F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_r", F.col("x._rare").alias("word"), F.col("x._times").alias("_t"))
    add = lambda c: F.sum(F.col("_t") * c)
    found = rare.join(table.filter(~frequent), "word").groupBy("_r").agg(
        F.sum(F.when(F.col("n") > 0, F.col("_t")).otherwise(0)).alias("_k"), add(F.col("base")).alias("_b"), add(F.col("score")).alias("_s"),
        *(add(F.col(c)).alias(f"_d{i}") for i, c in enumerate(kinds)))
    j = rows.drop("_rare", "_times").join(found, F.col("_row") == F.col("_r"), "left")
    both = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    tokens = F.col("_words") + 1
    of = F.array(*(both(f"_c{i}", f"_d{i}") - F.col("_words") * float(whole[i]) + float(n_classes[i]) for i in range(CLASSES)))
    best = F.array_max(of)
    mixture = best + F.log10(F.aggregate(of, F.lit(0.0), lambda total, x: total + F.pow(F.lit(10.0), x - best)))
    score = both("_score", "_s") + mixture + F.col("_words") * float(go) + float(stop)
    return j.select("doc_id", "held_out", tokens.alias("n_tokens"), (both("_known", "_k") + (1 if n_ends else 0)).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                    (both("_base", "_b") + float(np.log10(n_ends + 0.1)) - tokens * float(np.log10(norm))).alias("base_score"), score.alias("score"),
                    (-score * float(np.log2(10)) / F.greatest(F.col("_bytes"), F.lit(1))).alias("bits_per_byte"))
