"""Log probabilities of texts by a causal self-attention model, beside a word-count base.

Words of the training texts are counted over the whole corpus, and so are their subword
ids: by id, by the class that follows an id, and by the id that follows a class. These
counts are fixed logits of the model (see ``attention``). Its weights learn from every
window of the training texts, each in one of some rounds: the windows of a round are dealt
to learners by hash, each learner steps through its share from the same weights, and the
weights are averaged. The number of learners follows the number of tokens, so that no
learner's share grows.

Each text is cut into overlapping windows and every token scored once. What often follows
the beginning of a word is known from counts better than any small model can tell: those
counts, less a discount, come first, and the model shares what they leave.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramwise.llm import attention
from tramwise.llm.attention import Layout, Model, Shape
from tramwise.llm.common import crc_fold, lower_ascii, mix, slices, shuffles_dropped, small_batches, span_hashes, stage, text_slices, word_spans
from tramwise.llm.frequent import Tally, bar_of, distinct, frequent_keys, from_blobs, looked_up, to_blobs

FOLDS, HELD_OUT_FOLD = 5, 1
#: Words, and ids that follow the beginning of a word, whose counts are broadcast, at most
#: (16 and 28 bytes each). Others are joined.
FREQUENT = 1 << 20
#: The key of a text's end among words.
END = 0
#: Taken off each count of what follows the beginning of a word.
DISCOUNT = 0.8
#: Tokens that a learner has in a round, about; and tokens scored at a time.
SHARE, TOGETHER = 1_000_000, 400_000
#: Words in a generation of those that a worker remembers, about, and the longest in bytes.
REMEMBERED, SHORT = 200_000, 24
#: Parts of one in sums that do not depend on the order.
FINE = 1 << 32
#: Weights in a block, and blocks averaged at a time.
BLOCK, FAN = 1 << 16, 64


def _rows(docs: DataFrame) -> DataFrame:
    fold = crc_fold(F.col("doc_id").cast("long"), FOLDS)
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long"),
        F.coalesce(fold != HELD_OUT_FOLD, F.lit(False)).alias("learn"),
        F.coalesce(fold == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "text",
    )


def tallied(frame: DataFrame, keys_of) -> DataFrame:
    """(key, times): how often each key of ``keys_of(batch)`` occurs in all."""

    def run(batches):
        tally = Tally()

        def taken():
            keys, times, _ = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "times"])

        for batch in batches:
            for keys in keys_of(batch):
                own, _, which = distinct(keys.astype(np.int64, copy=False))
                if tally.add(own, np.bincount(which, minlength=len(own))):
                    yield taken()
        yield taken()

    return frame.mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))


# -- Words --------------------------------------------------------------------


def _words(data: np.ndarray, bounds: np.ndarray):
    data = lower_ascii(data)
    begin, end, counts = word_spans(data, bounds)
    return data, begin, end, counts, span_hashes(data, begin, end).view(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, times) of the words and ends of the training texts."""

    def keys_of(batch):
        for _, data, bounds in text_slices(batch.column("text")):
            yield np.r_[_words(data, bounds)[4], np.full(len(bounds) - 1, END)]

    return tallied(rows.where("learn").select("text"), keys_of)


class Subwords:
    """Ids of words as bytes, the latest remembered: two generations of them at most."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.held: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The 32-bit ids of each word, end to end."""
        found = list(map(self.held.get, words))
        missed = [i for i, f in enumerate(found) if f is None]
        for i in missed:
            found[i] = self.older.get(words[i])
        new = [i for i in missed if found[i] is None]
        texts = [words[i].decode("utf-8", "replace") for i in new]
        ids = self.model.encode(texts, num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))).tobytes()
        end = np.cumsum([4 * len(i) for i in ids]).tolist()
        for i, a, b in zip(new, [0, *end], end):
            found[i] = flat[a:b]
        for i in missed:
            if len(words[i]) <= SHORT:
                self.held[words[i]] = found[i]
        if len(self.held) > REMEMBERED:
            self.held, self.older = {}, self.held
        return found


@lru_cache(maxsize=2)
def _subwords(model: bytes) -> Subwords:
    return Subwords(model)


def _lists(cut: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))


TOKENS = (
    "row long, doc_id long, learn boolean, held_out boolean, n_tokens long, n_known long, "
    "base_score double, rare array<long>, rare_times array<int>, pieces binary"
)


def tokenised(rows: DataFrame, pieces, counts, total: int, different: int, end_times: int) -> DataFrame:
    """Base score over the frequent words, the other words, and subword ids of each text."""
    whole = np.log10(total + 0.5 * (different + 1))

    def run(batches):
        subwords, frequent = _subwords(pieces.value), counts.value
        end_id = subwords.model.get_piece_size()
        for batch in batches:
            for offset, data, bounds in text_slices(batch.column("text")):
                data, begin, end, many, keys = _words(data, bounds)
                n = len(many)
                row = np.repeat(np.arange(n), many)
                own, first, which = distinct(keys)
                times = looked_up(own, frequent)
                logs = (np.log10(times + 0.5) - whole)[which]
                base = np.bincount(row, logs, n) + np.log10(end_times + 0.5) - whole
                known = np.bincount(row, times[which] > 0, n).astype(np.int64) + (end_times > 0)
                rare = np.flatnonzero(times[which] == 0)
                code, rare_times = np.unique(row[rare] * max(len(own), 1) + which[rare], return_counts=True)
                rare_row = code // max(len(own), 1)
                held = data.tobytes()
                ids = subwords([held[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())])
                sizes = np.array([len(i) for i in ids], np.int64) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                each = sizes[which] if len(which) else np.zeros(0, np.int64)
                start = (np.cumsum(sizes) - sizes)[which] if len(which) else each
                at = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(each.sum())
                per_row = np.bincount(row, each, n).astype(np.int64)
                found = np.insert(flat[at], np.cumsum(per_row), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(offset, n) for c in ("row", "doc_id", "learn", "held_out")],
                        pa.array(many + 1),
                        pa.array(known),
                        pa.array(base),
                        _lists(np.searchsorted(rare_row, np.arange(n + 1)), own[code % max(len(own), 1)], pa.int64()),
                        _lists(np.searchsorted(rare_row, np.arange(n + 1)), rare_times, pa.int32()),
                        to_blobs(np.r_[0, np.cumsum(per_row + 1)], found),
                    ],
                    [f.split()[0] for f in TOKENS.split(", ")],
                )

    return rows.mapInArrow(run, TOKENS)


# -- The model ----------------------------------------------------------------


def _pieces(batch: pa.RecordBatch):
    """(first row, ids, sizes) of slices of a batch with a bounded number of ids."""
    sizes, ids = from_blobs(batch.column("pieces"), np.int32)
    bounds = np.r_[0, np.cumsum(sizes)]
    for first, end in slices(bounds, TOGETHER):
        yield first, ids[bounds[first] : bounds[end]], sizes[first:end]


def _table(counts: DataFrame, size: int) -> np.ndarray:
    """Counts of keys below ``size``, which the vocabulary bounds."""
    found = np.zeros(size, np.int64)
    table = counts.toArrow()
    found[table.column("key").to_numpy()] = table.column("times").to_numpy()
    return found


def initial_model(told: DataFrame, ids: int, shape: Shape) -> Model:
    """The model with the counts of all training texts and weights that know nothing."""
    learned = told.where("learn").select("pieces")
    layout = Layout(_table(tallied(learned, lambda batch: (own for _, own, _ in _pieces(batch))), ids))
    v, c = len(layout.members), layout.number
    plain = Model(layout, np.zeros((v + 2, c)), np.zeros((c + 2, v)), shape)
    held = told.sparkSession.sparkContext.broadcast(plain)
    cells = (v + 2) * c

    def keys_of(batch):
        model = held.value
        for _, own, sizes in _pieces(batch):
            last = attention.Texts(model, own, sizes).last
            yield last * c + model.layout.classes[own]
            yield cells + model.kinds[last] * v + model.layout.place[own]

    found = _table(tallied(learned, keys_of), cells + (c + 2) * v) if v else np.zeros(cells, np.int64)
    held.destroy()
    return Model(layout, found[:cells].reshape(v + 2, c), found[cells:].reshape(c + 2, v), shape)


WINDOWS = "draw long, before int, last int, size int, ids binary"


def training_windows(told: DataFrame, model, turn: int) -> DataFrame:
    """The windows that learn in a round; the rounds together have every window once."""

    def run(batches):
        held = model.value
        shape = held.shape
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, own, sizes in _pieces(batch):
                text, number, begin, places = attention.windows(sizes, shape)
                draw = mix(mix(rows[first + text].astype(np.uint64)) + number.astype(np.uint64))
                some = np.flatnonzero(draw % np.uint64(shape.slots) % np.uint64(shape.rounds) == turn)
                texts = attention.Texts(held, own, sizes)
                start, size = texts.first[text[some]] + begin[some], places[some]
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(draw[some].view(np.int64)),
                        pa.array(texts.before[start].astype(np.int32)),
                        pa.array(texts.last[start].astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        to_blobs(np.r_[0, np.cumsum(size)], own[at]),
                    ],
                    [f.split()[0] for f in WINDOWS.split(", ")],
                )

    return told.where("learn").select("row", "pieces").mapInArrow(run, WINDOWS)


PARTS = "block int, learner int, tokens long, weights binary"


def averaged(parts: DataFrame, learners: int) -> DataFrame:
    """One row for each block of weights: the mean over learners, weighed by tokens."""

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("learner")
        tokens = table.column("tokens").to_numpy()
        total = sum(
            np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n
            for w, n in zip(table.column("weights"), tokens)
        )
        return pa.table(
            {
                "block": table.column("block")[:1],
                "learner": table.column("group")[:1],
                "tokens": [int(tokens.sum())],
                "weights": [(total / tokens.sum()).astype(np.float32).tobytes()],
            }
        ).cast(pa.schema([("block", pa.int32()), ("learner", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())]))

    while learners > 1:
        grouped = parts.withColumn("group", F.expr(f"cast(learner div {FAN} as int)"))
        parts = grouped.groupBy("block", "group").applyInArrow(mean, PARTS)
        learners = -(-learners // FAN)
    return parts


def learned_round(windows: DataFrame, model, learners: int, rate: float) -> DataFrame:
    """The weights of each learner after its share of the windows, in blocks."""

    def run(table: pa.Table) -> pa.Table:
        held = model.value
        own = Model.__new__(Model)
        own.__dict__.update(held.__dict__)
        own.weights = {name: w.copy() for name, w in held.weights.items()}
        order = np.argsort(table.column("draw").to_numpy(), kind="stable")
        parts = [from_blobs(chunk, np.int32) for chunk in table.column("ids").chunks]
        sizes, ids = (np.concatenate(part) for part in zip(*parts))
        tokens = attention.learn(
            own,
            table.column("before").to_numpy(),
            table.column("last").to_numpy(),
            ids,
            sizes,
            order,
            rate,
        )
        flat = own.flat()
        blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
        learner = table.column("learner")[0].as_py()
        return pa.table(
            [
                pa.array(range(len(blocks)), pa.int32()),
                pa.array([learner] * len(blocks), pa.int32()),
                pa.array([tokens] * len(blocks), pa.int64()),
                pa.array(blocks, pa.binary()),
            ],
            ["block", "learner", "tokens", "weights"],
        )

    # The low bits of the draw chose the round.
    dealt = windows.withColumn("learner", F.expr(f"cast(pmod(xxhash64(draw), {learners}) as int)"))
    return dealt.groupBy("learner").applyInArrow(run, PARTS)


def trained(told: DataFrame, ids: int, shape: Shape) -> Model:
    """The model after all rounds."""
    spark = told.sparkSession
    model = initial_model(told, ids, shape)
    held = spark.sparkContext.broadcast(model)
    # Windows overlap, so they hold more tokens than the texts.
    tokens = int(model.layout.counts.sum()) * shape.window // shape.stride
    for turn in range(shape.rounds if tokens else 0):
        learners = -(-tokens // (shape.rounds * SHARE))
        windows = training_windows(told, held, turn)
        parts = learned_round(windows, held, learners, shape.rate / (1 + turn) ** 0.5)
        blocks = sorted(averaged(parts, learners).select("block", "weights").collect())
        if not blocks:  # fewer windows than rounds
            continue
        model.take(np.concatenate([np.frombuffer(b.weights, np.float32) for b in blocks]))
        held.destroy()
        held = spark.sparkContext.broadcast(model)
    held.destroy()
    return model


# -- What follows the beginning of a word -------------------------------------


_UP, _DOWN = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


#: The beginning of an id that opens a word.
OPENING = 0


def beginnings(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
    """(beginning, key) of each id: hashes of its word's ids before it, and with it.

    The key is the beginning of the id that follows in the word.
    """
    n = len(ids)
    opens = starts[ids]
    opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    own = mix(np.arange(1, len(starts) + 1, dtype=np.uint64)).take(ids)
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)]) for base in (_UP, _DOWN))
    sums = np.r_[np.uint64(0), np.cumsum(own * up[:-1])]
    keys = mix((sums[1:] - sums[first]) * down[first]).view(np.int64)
    before = np.r_[OPENING, keys[:-1]] if n else keys
    before[opens] = OPENING
    return before, keys


def continuations(told: DataFrame, starts) -> DataFrame:
    """(key, times, beginning): how often each id follows the beginning of a word."""

    def run(batches):
        tally = Tally()

        def taken():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in tally.take()], ["key", "times", "beginning"])

        for batch in batches:
            for _, ids, sizes in _pieces(batch):
                before, keys = beginnings(ids, sizes, starts.value)
                keys, first, which = distinct(keys)
                if tally.add(keys, np.bincount(which, minlength=len(keys)), before[first]):
                    yield taken()
        yield taken()

    part = told.where("learn").select("pieces").mapInArrow(run, "key long, times long, beginning long")
    return part.groupBy("key").agg(F.sum("times").alias("times"), F.min("beginning").alias("beginning"))


def shares(counts: DataFrame) -> DataFrame:
    """(key, times, share, rest, left) of every key of ``counts``.

    ``share`` is the key's of its beginning, ``rest`` what the shares of all keys leave of
    that beginning, and ``left`` what they leave of the key's own, if it is the beginning
    of any.
    """
    follow = counts.groupBy("beginning").agg(
        F.sum("times").alias("whole"), (DISCOUNT * F.count("*") / F.sum("times")).alias("rest")
    )
    after = follow.select(F.col("beginning").alias("key"), F.col("rest").alias("left"))
    return (
        counts.join(follow, "beginning")
        .join(after, "key", "left")
        .select(
            "key", "times", ((F.col("times") - DISCOUNT) / F.col("whole")).alias("share"), "rest",
            F.coalesce("left", F.lit(1.0)).alias("left"),
        )
    )


@dataclass
class Shares:
    """Of the frequent keys, sorted, and of the others together at the end."""

    keys: np.ndarray
    share: np.ndarray
    left: np.ndarray
    opening: float  # what the shares leave of the words' openings
    others: bool  # whether training texts have other keys

    def __call__(self, before: np.ndarray, keys: np.ndarray):
        """(share, rest, known) of each id, from its beginning and its key."""
        own, _, which = distinct(keys)  # in order, look-ups stay in the processor's cache
        at = looked_up(own, (self.keys, np.arange(len(self.keys), dtype=np.int32)), -1)
        left = self.left[at][which]
        rest = np.where(before == OPENING, self.opening, np.r_[1.0, left][: len(left)])
        return self.share[at][which], rest, (at >= 0)[which]


def counted_shares(told: DataFrame, starts, frequent: int) -> tuple[Shares, DataFrame]:
    """The shares of the frequent keys, and a table of those of the others."""
    counts = stage(continuations(told, starts), "continuations")
    bar, below = bar_of(counts, frequent)
    opening = counts.where(F.col("beginning") == OPENING).agg(F.sum("times"), F.count("*")).first()
    table = stage(shares(counts), "shares")
    often = table.where(F.col("times") >= bar).toArrow()
    keys, share, left = (often.column(c).to_numpy() for c in ("key", "share", "left"))
    order = np.argsort(keys)
    held = Shares(
        keys[order],
        np.r_[share[order], 0.0],
        np.r_[left[order], 1.0],
        DISCOUNT * opening[1] / opening[0] if opening[1] else 1.0,
        below > 0,
    )
    return held, table.where(F.col("times") < bar)


SCORES = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
    "score double, rare array<long>, rare_times array<int>, "
    "asked array<long>, asked_logs array<double>, goes_on array<boolean>"
)


def scored(told: DataFrame, model, starts, tables) -> DataFrame:
    """Scores by the frequent keys, as though training texts had no others.

    ``asked`` are the other keys, if training texts have any, ``asked_logs`` the natural
    logs of their ids' probability by the model, and ``goes_on`` whether another id of the
    same word follows (see ``gains``).
    """
    names = [f.split()[0] for f in SCORES.split(", ")]

    def run(batches):
        held, opens, shares = model.value, starts.value, tables.value

        def score(ids, sizes):
            before, keys = beginnings(ids, sizes, opens)
            share, rest, known = shares(before, keys)
            logs = attention.logs(held, ids, sizes)
            asked = np.flatnonzero(~known) if shares.others else np.zeros(0, np.int64)
            goes_on = np.r_[before[1:] != OPENING, False][asked]
            many = np.diff(np.searchsorted(asked, np.r_[0, np.cumsum(sizes)]))
            return attention.totals(logs, sizes, share, rest), many, keys[asked], logs[asked], goes_on

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [score(ids, sizes) for _, ids, sizes in _pieces(batch)]
            total, many, *asked = (np.concatenate(part) for part in zip(*parts))
            own = {c: batch.column(c) for c in names if c in batch.schema.names}
            own["score"] = pa.array(total)
            cut = np.r_[0, np.cumsum(many)]
            for name, values, kind in zip(names[-3:], asked, (pa.int64(), pa.float64(), pa.bool_())):
                own[name] = _lists(cut, values, kind)
            yield pa.RecordBatch.from_arrays([own[c] for c in names], names)

    return told.mapInArrow(run, SCORES)


def gains(found: DataFrame, rare: DataFrame) -> DataFrame:
    """(row, gain): what each asked key that training texts have adds to the score.

    Its own id has the share that the model was given, and the id that goes on what the
    shares leave: of a beginning that training texts lack, which the score assumed, they
    leave all.
    """
    asked = found.select("row", F.explode(F.arrays_zip("asked", "asked_logs", "goes_on")).alias("p")).select(
        "row", F.col("p.asked").alias("key"), F.col("p.asked_logs").alias("log"), F.col("p.goes_on").alias("goes_on")
    )
    own = F.log(F.col("share") + F.col("rest") * F.exp("log")) - F.log("rest") - F.col("log")
    more = F.when(F.col("goes_on"), F.log("left")).otherwise(0.0)
    return asked.join(rare.drop("times"), "key").select("row", ((own + more) / float(np.log(10))).alias("gain"))


def score_texts(
    docs: DataFrame, vocabulary: str | None = None, shape: Shape = Shape(), frequent: int = FREQUENT
) -> DataFrame:
    """The log10 probability of every whole text, by the model and by counted words.

    Texts learn unless crc32 of the id, modulo 5, is 1. A-Z count as lower case; the
    tokens of a text are its words and one end. Columns: doc_id, held_out, n_tokens,
    n_known (tokens that training texts have), train_tokens, base_score (each token
    counted with 0.5 added, over all), score (the model's: of the subword ids of the words,
    in order, and of the end); a row for each row of ``docs``. ``vocabulary`` is the path of
    a piece model. The weights learn from every window of the training texts, each once,
    in ``shape.rounds`` rounds; everything else from all training texts as well.

    A NULL or empty text has one token, its end. Repeated rows learn and are scored each
    time. A row with a NULL id is scored and neither learned from nor held out. Without
    training texts all ids are equally likely and ``base_score`` counts nothing. Other
    columns are not read. Words are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        held = f.read()
    pieces = spark.sparkContext.broadcast(held)
    splitter = sentencepiece.SentencePieceProcessor(model_proto=held)
    ids = splitter.get_piece_size() + 1  # and the end
    rows = _rows(docs)
    with shuffles_dropped(spark):
        counts = stage(word_counts(rows), "word-counts")
        end, total, different = counts.select(
            F.sum(F.when(F.col("key") == END, F.col("times"))), F.sum("times"), F.count("*")
        ).first()
        end, total = end or 0, total or 0
        bar, below = bar_of(counts, frequent)
        often = spark.sparkContext.broadcast(frequent_keys(counts, bar))
        told = stage(tokenised(rows, pieces, often, total, different, end), "lm-tokens")
        starts = spark.sparkContext.broadcast(
            np.array([splitter.id_to_piece(i).startswith("▁") for i in range(ids - 1)] + [True])
        )
        often_follow, others = counted_shares(told, starts, frequent)
        tables = spark.sparkContext.broadcast(often_follow)
        model = spark.sparkContext.broadcast(trained(told, ids, shape))
        found = scored(told, model, starts, tables)
        if below or often_follow.others:
            found = stage(found, "lm-scores")
    # What the rest of the words and of the keys add, from a join each.
    parts = []
    if below:
        rare = found.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("p")).select(
            "row", F.col("p.rare").alias("key"), F.col("p.rare_times").cast("long").alias("many")
        )
        gain = (F.log10(F.col("times") + 0.5) - F.log10(F.lit(0.5))) * F.col("many")
        parts.append(
            rare.join(counts.where(F.col("times") < bar), "key").select(
                "row", F.col("many").alias("known"), gain.alias("base"), F.lit(0.0).alias("gain")
            )
        )
    if often_follow.others:
        parts.append(gains(found, others).select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "gain"))
    if parts:
        exact = lambda c: F.sum(F.rint(F.col(c) * FINE).cast("long")) / FINE
        more = reduce(DataFrame.unionAll, parts).groupBy("row").agg(
            F.sum("known").alias("known"), exact("base").alias("base"), exact("gain").alias("gain")
        )
        found = (
            found.join(more, "row", "left")
            .withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0)))
            .withColumn("base_score", F.col("base_score") + F.coalesce("base", F.lit(0.0)))
            .withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
        )
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
