"""Language-model scores of whole texts (operator 10).

Two models learn from the training texts.  The base is the add-one unigram model of
words.  The other is a causal self-attention model on the stream of subword ids, trained
in numpy (:mod:`scriptorium.llm.attention`).  It reads a text as the base does: A-Z
lower-cased, words with one space before each; its score is the log10 probability of the
ids and the end.

What is gathered covers every training text: the count of every word, from those the
counts of every subword id and the table of frequent words, and the attention weights.
These are trained on executors, in one pass over all training texts: a hash deals them to
a fixed number of rounds, the tasks of a round have the same start, and weights are
averaged, weighted by tokens, after each round.

Scoring is one pass.  The most frequent words' counts are a broadcast table of bounded
size; other words of a text are emitted and joined with the full counts, so every count
is exact.  A text is scored in windows that overlap by the context, each id once.
"""

from __future__ import annotations

import base64
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import attention
from scriptorium.llm.packing import PATTERN
from scriptorium.llm.shared import map_batches, remainder, settle, slices, text_rows, written

#: Entries of the broadcast table, and distinct words that a worker keeps at hand.
TABLE = 250_000
KEPT_WORDS = 400_000
#: Training: rounds that share out the texts, the same number at every size; ids of the first steps and of the longest; steps until the full rate.
ROUNDS = 4
FIRST_STEP, STEP = 128, 4096
RATE, WARM = 0.03, 20
SEED = 11
_loaded: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; ``bytes.split`` separates at exactly the bytes 9 to 13 and 32."""
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """As :func:`words_of` for many texts, in Arrow: words of each text, the number of each word among the distinct, those."""
    own = texts.take(pa.array(np.arange(len(texts))))  # a slice of a batch would be split at its batch's places
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own.cast(pa.large_string()), "")))
    lengths, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)
    some = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty word there
    lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths)).astype(np.int64)
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return lengths, coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()


def encoder(ranks: str):
    """A byte-level BPE's ids of a text, and whether each id's bytes begin with a space."""
    if ranks not in _loaded:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        begins = np.zeros(len(merges), bool)
        begins[[i for b, i in merges.items() if b[:1] == b" "]] = True
        _loaded[ranks] = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary, begins
    return _loaded[ranks]


def tokens_of(words: list[bytes], ranks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of words in one row, the number of each id's word, and whether it is the word's first.

    Words hold no space, so in a text where one stands before each, exactly the first ids
    of words begin with it.
    """
    encode, begins = encoder(ranks)
    flat = np.array(encode("".join(" " + w.decode() for w in words)), np.int64)
    leads = begins[flat]
    return flat, np.cumsum(leads) - 1, leads


class Lexicon:
    """A worker's words: slots of their subword ids, logarithms of the ids' shares of those, base logarithms.

    Words that are met are kept until ``most`` are; then all make room for new ones.  Place
    0 is the end of a text, whose slot is 0.
    """

    def __init__(self, counts: np.ndarray, ranks: str, table: dict[bytes, int] | None = None, shift: float = 0.0, most: int = KEPT_WORDS):
        self.slot, self.within = attention.slots_of(counts)
        self.ranks, self.table, self.shift, self.most = ranks, table or {}, shift, most
        self.flat = np.zeros(8 * most, np.int16)
        self.begin, self.size = np.zeros(most, np.int64), np.ones(most, np.int64)
        self.inside, self.base = np.zeros(most), np.full(most, np.nan)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.used, self.filled = 1, 1

    def places(self, distinct: list[bytes]) -> np.ndarray:
        found = list(map(self.index.get, distinct))
        missing = [w for w, i in zip(distinct, found) if i is None]
        if self.used + len(missing) > len(self.size):
            self.clear()
            missing = distinct
        if missing:
            self.learn(missing)
            found = [self.index[w] for w in distinct]
        return np.array(found, np.int64)

    def learn(self, words: list[bytes]) -> None:
        ids, word, _ = tokens_of(words, self.ranks)
        begin, end = self.used, self.used + len(words)
        if end > len(self.size):  # one batch with more words than are kept: the arrays grow
            more = end - len(self.size)
            self.begin, self.size, self.inside, self.base = (np.pad(x, (0, more)) for x in (self.begin, self.size, self.inside, self.base))
        if self.filled + len(ids) > len(self.flat):
            self.flat = np.pad(self.flat, (0, max(len(ids), len(self.flat) // 2)))
        self.flat[self.filled : self.filled + len(ids)] = self.slot[ids]
        sizes = np.bincount(word, minlength=len(words))
        self.begin[begin:end], self.size[begin:end] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.inside[begin:end] = np.bincount(word, weights=self.within[ids], minlength=len(words))
        known = np.array([self.table.get(w, 0) for w in words], np.float64)
        self.base[begin:end] = np.where(known > 0, np.log10(known + 1) - self.shift, np.nan)
        self.index.update(zip(words, range(begin, end)))
        self.used, self.filled = end, self.filled + len(ids)

    def stream(self, lengths: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What precedes each id of some texts, the text of each, and the id itself, as slots; ends included."""
        places = np.insert(number, np.cumsum(lengths), 0)
        sizes = self.size[places]
        text = np.repeat(np.repeat(np.arange(len(lengths)), lengths + 1), sizes)
        target = self.flat[np.arange(len(text)) + np.repeat(self.begin[places] - np.cumsum(sizes) + sizes, sizes)].astype(np.int64)
        return np.concatenate([[0], target[:-1]]), text, target


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of all rows; the word ``null`` has the number of texts, for their ends."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        seen, texts = Counter(), 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)

        for whole in batches:
            for batch in slices(whole, 4 << 20):
                _, numbers, distinct = split_words(batch.column("text"))
                texts += batch.num_rows
                for word, n in zip(distinct, np.bincount(numbers, minlength=len(distinct)).tolist()):
                    seen[word] += n
                if len(seen) > 600_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([texts], pa.int64())], schema=schema)

    return rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words, all of those with as many occurrences or none, at most ``most``.

    How often each count occurs tells which count to stop at: no list of candidates is merged.
    """
    words = counts.where("word IS NOT NULL")
    total, least = 0, None
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += r.words
        if total > most:
            break
        least = r.n
    if least is None:
        return {}
    top = words.where(F.col("n") >= least).toPandas()
    return dict(zip(map(str.encode, top["word"]), top["n"].tolist()))


def id_counts(counts: DataFrame, ranks: str) -> np.ndarray:
    """How often each subword id occurs in the counted words: an array as long as the vocabulary."""
    size = len(encoder(ranks)[1])

    def count(batches):
        found = np.zeros(size)
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                ids, word, _ = tokens_of([w.encode() for w in batch.column("word").to_pylist()], ranks)
                found += np.bincount(ids, weights=np.array(batch.column("n").to_pylist(), np.float64)[word], minlength=size)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used].astype(np.int64))], names=["id", "n"])

    summed = counts.where("word IS NOT NULL").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most a row an id
    out = np.zeros(size)
    out[summed["id"].to_numpy(np.int64)] = summed["n"].to_numpy()
    return out


def flat_weights(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def shaped_weights(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    parts = np.split(flat.astype(np.float32), np.cumsum([w.size for w in like.values()])[:-1])
    return {k: part.reshape(w.shape) for (k, w), part in zip(like.items(), parts)}


def _train_task(lexicon: Lexicon, weights: dict[str, np.ndarray], rate: float, batches):
    """Weights after one pass over a task's texts, as rows (place, value, tokens)."""
    adam, total = attention.Adam(weights), 0
    for whole in batches:
        for batch in slices(whole, 1 << 20):
            lengths, numbers, distinct = split_words(batch.column("text"))
            before, text, target = lexicon.stream(lengths, lexicon.places(distinct)[numbers] if distinct else numbers)
            at = 0
            while at < len(target):  # steps grow with what the task has read; all ids are in one
                most = min(STEP, FIRST_STEP + total // 8)
                end = len(target) if len(target) - at < 3 * most // 2 else at + most
                slopes, _ = attention.gradients(weights, before[at:end], text[at:end], target[at:end])
                adam.step(slopes, rate * min(1.0, (adam.steps + 1) / WARM))
                total, at = total + end - at, end
    if total:
        flat = flat_weights(weights).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), total))], names=["place", "value", "tokens"])


def train(rows: DataFrame, texts: int, counts: np.ndarray, ranks: str) -> dict[str, np.ndarray]:
    """Attention weights, from one pass over all rows; each row is in one round, copies of a text in any.

    Tasks are those of the scan, so no text is shuffled.  What comes back is a row a weight
    and task, averaged before the driver sees it, weighted by the tokens each task has read.
    """
    slot, _ = attention.slots_of(counts)
    often = np.bincount(slot, weights=counts, minlength=attention.SLOTS)
    often[0] = texts
    weights = attention.fresh(SEED, often)
    context = rows.sparkSession.sparkContext
    for turn in range(ROUNDS):
        part = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(ROUNDS)) == turn).select("text")
        start = context.broadcast((weights, counts))  # some 60,000 weights and a number for each id
        rate = RATE / (1 + turn)

        def task(batches, start=start, rate=rate):
            settle()
            weights, counts = start.value
            yield from _train_task(Lexicon(counts, ranks), {k: v.copy() for k, v in weights.items()}, rate, batches)

        moved = part.mapInArrow(task, "place int, value double, tokens long")
        means = moved.groupBy("place").agg((F.sum(F.col("value") * F.col("tokens")) / F.sum("tokens")).alias("value")).toPandas()  # a row a weight
        if len(means):
            flat = np.empty(len(means))
            flat[means["place"].to_numpy()] = means["value"].to_numpy()
            weights = shaped_weights(flat, weights)
        start.unpersist()
    return weights


def score_batch(lexicon: Lexicon, tables: attention.Tables, texts: pa.Array) -> dict:
    """Words, known of tabled words, their base, words the table lacks, score, of each text."""
    lengths, numbers, distinct = split_words(texts)
    many = len(lengths)
    number = lexicon.places(distinct)[numbers] if distinct else numbers
    text = np.repeat(np.arange(many), lengths)
    base = lexicon.base[number]
    lacking = np.isnan(base)
    before, of_id, target = lexicon.stream(lengths, number)
    logs = attention.predict(tables, before, of_id, target).astype(np.float64)
    total = np.bincount(of_id, weights=logs, minlength=many) + np.bincount(text, weights=lexicon.inside[number], minlength=many)
    pairs, times = np.unique(text[lacking] * len(distinct) + numbers[lacking], return_counts=True)
    of, word = np.divmod(pairs, max(1, len(distinct)))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=many))]).astype(np.int32))
    rare = pa.array(distinct, pa.binary()).take(pa.array(word)).cast(pa.string())
    missed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([rare, pa.array(times, pa.int64())], names=["word", "n"]))
    return {
        "words": lengths, "known": lengths - np.bincount(text, weights=lacking, minlength=many).astype(np.int64),
        "base": np.bincount(text, weights=np.where(lacking, 0, base), minlength=many), "missed": missed, "score": total / math.log(10),
    }


def score_texts(df: DataFrame, ranks: str, modulus: int = 7, held_out: int = 2, key: str = "doc_id", text: str = "text", table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    A null or empty text is its end alone.  Without training texts all counts are 0, V and
    N are 0, and the attention model has its first weights.  Repeated rows are rows each,
    and count each in training; null keys count as the key ''.  Empty table: no rows;
    other columns are not read.
    """
    rows = text_rows(df, key, text).withColumn("held_out", remainder("doc_id", modulus) == held_out)
    learned = rows.where("NOT held_out")
    counts = written(word_counts(learned), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    tokens, distinct, texts = (int(x) for x in totals)
    shift = math.log10(tokens + distinct + 1)
    ids = id_counts(counts, ranks)
    frequent = frequent_words(counts, table)
    weights = train(learned, texts, ids, ranks)
    shared = df.sparkSession.sparkContext.broadcast((weights, ids, frequent))

    def start():
        settle()
        weights, ids, known = shared.value
        if _loaded.get("reader", (None,))[0] != id(known):
            _loaded["reader"] = id(known), Lexicon(ids, ranks, known, shift), attention.Tables(weights)
        _, lexicon, tables = _loaded["reader"]
        number = TaskContext.get().partitionId() << 40

        def fill(batch: pa.RecordBatch) -> dict:
            nonlocal number
            out = score_batch(lexicon, tables, batch.column("text"))
            number += batch.num_rows
            return out | {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "row": np.arange(number - batch.num_rows, number)}

        return fill

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = map_batches(rows, start, f"row long, doc_id {kind}, held_out boolean, words long, known long, base double, missed array<struct<word:string,n:long>>, score double", most=3 << 20)
    scored = written(scored, "scores")
    missed = scored.select("row", F.explode("missed").alias("m")).select("row", F.col("m.word").alias("word"), F.col("m.n").alias("times"))
    found = missed.join(counts.where("word IS NOT NULL"), "word", "left")
    more = found.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - shift)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    end = math.log10(texts + 1) - shift
    zero = F.lit(0)
    return scored.drop("missed").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("also", zero) + int(texts > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero.cast("double")) + end).alias("base_score"),
        "score",
    )
