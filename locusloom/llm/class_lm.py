"""Brown's class-based bigram model: words are put into classes by exchange clustering, and
P(w_i | w_i-1) = P(class_i | class_i-1) P(w_i | class_i).

Tokens are runs without ASCII white space with A-Z lowered, then one end for each text. Words are counted over all training texts.
The most frequent words, ``HEAD`` at most, travel to every task; all others are the tail, which stays a distributed table and
is joined by word, so memory doesn't grow with the vocabulary. Texts are written once as head places (tail words as their shape).

1. The ``CLUSTERED`` most frequent words are clustered by sequential exchange on their bigram counts, a matrix of fixed size.
2. All other head words join in by rounds of exchange that run side by side: every word's counts of classes before and after it, over
   all training texts, are summed by word in Spark, and it moves to the class that raises the likelihood of the class table most.
   Rounds end when the likelihood no longer rises, after ``ROUNDS`` at most.
3. Tail words, and words that training texts lack, are in one of ``SHAPES`` classes by their last byte and other letters than ASCII's.

Smoothing: class transitions and emissions add constants, and every class of the tail keeps the mass of one unknown word, so the
probabilities of all classes after a class, and of all words of a class, sum to one.

Null text is empty: its only token is the end. Ids are integers; null ids are held in or out as their hash of null says (never held
out); repeated rows are scored each; other columns are ignored; an empty table gives an empty result; with no training text every word is unknown.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, count_floor, id_and_bytes, staged, worker_of

HEAD = 200_000
CLUSTERED = 768
CLASSES = 64
SHAPES = 10
ROUNDS = 3
#: Head words are dealt into so many parts, in which their neighbours' classes are summed.
PARTS = 1024
#: Added to a class transition's count, to a word's count within its class.
TRANSITION, EMISSION = 0.02, 0.5
END = b"\n"  # no word has white space


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(-1)).cast("int")


def shape(word: bytes) -> int:
    """A class for a word by its bytes: five kinds of last byte, with ASCII letters only or not."""
    last = word[-1]
    kind = 0 if 97 <= last <= 122 or last >= 128 else 1 if last == 46 else 2 if last == 44 else 3 if 48 <= last <= 57 else 4
    return kind if word.isascii() else kind + 5


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: only A-Z, only ASCII white space


def count_batches(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    worker_of("class model")
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for whole in batches:
        for batch, texts in by_bytes(whole):
            counts.update(b"\n".join(texts).lower().split())
            counts[END] += batch.num_rows
            if len(counts) > most:
                yield out()
                counts = Counter()
    if counts:
        yield out()


class Places:
    """Word -> place in the head by frequency; others by shape, below zero."""

    def __init__(self, words: list[bytes]):
        self.of = {w: k for k, w in enumerate(words)}
        self.of[END] = self.of.get(END, len(words))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        get = self.of.get
        return np.array([k if (k := get(w)) is not None else -1 - shape(w) for w in words], np.int64)


def coded(texts: list[bytes]) -> list[bytes]:
    """The tokens of all texts as one list, each text's end after it."""
    out: list[bytes] = []
    for t in texts:
        out += t.lower().split()
        out.append(END)
    return out


CODED = "rid bigint, doc_id bigint, train boolean, ids binary, tail array<binary>"


def coded_batches(batches: Iterator[pa.RecordBatch], head: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, train) -> the text's tokens as places (32-bit, little-endian), its tail words, and a number for the row."""
    worker_of("class model")
    place, rid = Places(head), TaskContext.get().partitionId() << 40
    for whole in batches:
        for batch, texts in by_bytes(whole):
            words = coded(texts)
            at = place(words)
            ends = np.flatnonzero(at == place.of[END])
            raw, cuts = at.astype("<i4").tobytes(), [0, *((ends + 1) * 4).tolist()]
            tail = np.flatnonzero(at < 0)
            cut = np.searchsorted(tail, np.concatenate(([0], ends + 1)))
            rest = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array([words[k] for k in tail.tolist()], pa.binary()))
            n = len(ends)
            ids = pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + n), pa.int64()), batch.column(0), batch.column(2), ids, rest], ["rid", "doc_id", "train", "ids", "tail"])
            rid += n


def places_of(column: pa.Array) -> np.ndarray:
    """The places of all texts of a batch, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4")


def pair_batches(batches: Iterator[pa.RecordBatch], group: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent groups; ``group``: of each place, the tail's shapes last and from the end. The end also stands before a text."""
    worker_of("class model")
    total = np.zeros(width * width, np.int64)
    for batch in batches:
        now = group[places_of(batch.column(0))]
        if len(now):
            total += np.bincount(np.concatenate((now[-1:], now[:-1])) * width + now, minlength=width * width)  # a text follows an end, as the last token of all is one
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def neighbour_batches(batches: Iterator[pa.RecordBatch], group: np.ndarray, width: int, first: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """For head words from place ``first`` on: how often each class stands before (side 0) and after (side 1) each. A row has the cells
    of one part of the words and their counts, packed."""
    worker_of("class model")
    held, size = [], 0

    def out() -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        part = (cells // (2 * width)) % PARTS
        order = np.argsort(part, kind="stable")
        cells, counts, cut = cells[order].astype("<i8"), counts[order].astype("<i4"), np.searchsorted(part[order], np.arange(PARTS + 1))
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        columns = [pa.array([k for k, _, _ in spans], pa.int32()), *(pa.array([x[a:b].tobytes() for _, a, b in spans], pa.binary()) for x in (cells, counts))]
        return pa.RecordBatch.from_arrays(columns, ["part", "cells", "counts"])

    for batch in batches:
        at = places_of(batch.column(0))
        if not len(at):
            continue
        now = group[at]
        for side, other in enumerate((np.concatenate((now[-1:], now[:-1])), np.concatenate((now[1:], now[:1])))):
            mine = np.flatnonzero(at >= first)
            held.append(((at[mine].astype(np.int64) - first) * 2 + side) * width + other[mine])
            size += len(mine)
        if size >= most:
            yield out()
            size = 0
    if size:
        yield out()


def moved_batches(batches: Iterator[pa.RecordBatch], of: np.ndarray, table: np.ndarray, classes: int, first: int) -> Iterator[pa.RecordBatch]:
    """(part, cells, counts), all rows of a part in one task -> (word, class): the class of the greatest gain, the own one among equals."""
    worker_of("class model")
    width, sums = len(table), {}
    words = max(len(of) - first, 0)
    for batch in batches:
        for part, cells, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if part not in sums:
                sums[part] = np.zeros((-(-words // PARTS) + 1) * 2 * width, np.int64)
            at = np.frombuffer(cells, "<i8")
            sums[part] += np.bincount((at // (2 * width)) // PARTS * (2 * width) + at % (2 * width), np.frombuffer(counts, "<i4"), len(sums[part])).astype(np.int64)
    for part, total in sums.items():
        total = total.reshape(-1, 2, width)
        seen = np.flatnonzero(total.any((1, 2)))
        for some in np.array_split(seen, len(seen) // 200 + 1):
            word = some * PARTS + part + first
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best_classes(total[some], of[word], table, classes).astype(np.int64))], ["word", "class"])


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def best_classes(near: np.ndarray, own: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """For words with counts of classes before and after (word, side, class): the class whose row and column of the class table gain
    most by them. A word counts as taken out of its own class first."""
    gain = np.zeros((len(near), classes))
    for side, view in ((1, table[:classes]), (0, table[:, :classes].T)):
        row, k = np.nonzero(near[:, side])
        n = near[row, side, k].astype(float)
        cell = view[:, k].T  # of each nonzero count, the cell of every class
        add = entropy(cell + n[:, None]) - entropy(cell)
        home = np.flatnonzero(own[row] < classes)
        c = own[row[home]]
        full = cell[home, c]
        add[home, c] = entropy(full) - entropy(np.maximum(full - n[home], 0))
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            gain[row[first]] += np.add.reduceat(add, first)
        size, whole = view.sum(1), near[:, side].sum(1).astype(float)
        loss = entropy(size + whole[:, None]) - entropy(size)
        mine = np.flatnonzero(own < classes)
        loss[mine, own[mine]] = entropy(size[own[mine]]) - entropy(np.maximum(size[own[mine]] - whole[mine], 0))
        gain -= loss
    best = gain.argmax(1)
    stay = np.minimum(own, classes - 1)
    keep = (own < classes) & (gain[np.arange(len(own)), stay] >= gain[np.arange(len(own)), best] - 1e-9)
    return np.where(keep, own, best)


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, but for what doesn't depend on the classes."""
    return float(entropy(table).sum() - entropy(table.sum(0)).sum() - entropy(table.sum(1)).sum())


def summed(pairs: DataFrame, width: int) -> np.ndarray:
    """(pair, n) rows as a matrix; at most width * width numbers."""
    total = np.zeros(width * width)
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return total.reshape(width, width)


def grouped(of: np.ndarray, groups: int) -> np.ndarray:
    """Groups by place, then, to be found from the end, the tail's shapes: groups from ``groups`` on."""
    return np.concatenate((of, groups + np.arange(SHAPES)[::-1]))


def clustered_head(train: DataFrame, head: list[bytes], clustered: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each head word (places by frequency), and the counts of class bigrams, in which the tail's shapes are the last classes.

    ``train``: a column of coded texts. Only matrices of fixed size and a class for each head word come to the driver.
    """
    clustered = min(clustered, len(head))
    shapes = np.array([shape(w) if w != END else 0 for w in head], np.int64)
    group = grouped(np.where(np.arange(len(head)) < clustered, np.arange(len(head)), clustered + shapes), clustered)
    width = clustered + SHAPES
    pairs = summed(train.mapInArrow(lambda it: pair_batches(it, group, width), "pair bigint, n bigint"), width)
    of = np.where(np.arange(len(head)) < clustered, 0, classes + shapes)
    of[:clustered] = exchange(pairs, clustered, classes)[:clustered]
    width = classes + SHAPES

    def counted(now: np.ndarray) -> np.ndarray:
        group = grouped(now, classes)
        return summed(train.mapInArrow(lambda it: pair_batches(it, group, width), "pair bigint, n bigint"), width)

    def exchanged(now: np.ndarray, table: np.ndarray) -> np.ndarray:
        group, out = grouped(now, classes), now.copy()
        near = train.mapInArrow(lambda it: neighbour_batches(it, group, width, clustered), "part int, cells binary, counts binary").repartition("part")
        rows = near.mapInArrow(lambda it: moved_batches(it, now, table, classes, clustered), "word bigint, class bigint").toArrow()
        out[rows["word"].to_numpy()] = rows["class"].to_numpy()
        return out

    table = counted(of)
    for nth in range(rounds if len(head) > clustered else 0):
        new = exchanged(of, table)
        then = counted(new)
        if nth and likelihood(then) <= likelihood(table):  # the first round takes words out of the shapes' classes, which all have to leave
            break
        of, table = new, then
    return of, table


def exchange(pairs: np.ndarray, clustered: int, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each group: the clustered words are moved, one at a time, to the class that raises the likelihood most."""
    width = len(pairs)
    count = pairs.sum(1)
    of = np.concatenate((np.arange(clustered) % classes, classes + np.arange(width - clustered)))
    many = classes + width - clustered
    one = np.zeros((width, many))
    one[np.arange(width), of] = 1
    right, left = pairs @ one, pairs.T @ one  # by word: counts with the class after, before
    table = one.T @ right
    h = lambda x: x * np.log(np.maximum(x, 1e-9))
    for _ in range(rounds):
        moves = 0
        for w in range(clustered):
            if not count[w]:
                continue
            c, r, l, own = of[w], right[w], left[w], pairs[w, w]
            # take w out
            table[c] -= r
            table[:, c] -= l
            table[c, c] += own
            r, l = r.copy(), l.copy()
            r[c] -= own
            l[c] -= own
            rows, cols = table[:classes], table[:, :classes].T
            gain = (h(rows + r) - h(rows)).sum(1) + (h(cols + l) - h(cols)).sum(1)
            k = np.arange(classes)
            cell = table[k, k]  # the cell on the diagonal was counted in both sums
            gain += h(cell + r[k] + l[k] + own) - h(cell) - (h(cell + r[k]) - h(cell)) - (h(cell + l[k]) - h(cell))
            size, back = rows.sum(1), cols.sum(1)
            gain -= h(size + count[w]) - h(size) + h(back + count[w]) - h(back)
            new = int(np.argmax(gain))
            r[new] += own
            l[new] += own
            table[new] += r
            table[:, new] += l
            table[new, new] -= own
            if new != c:
                moves += 1
                of[w] = new
                right[:, c] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, c] -= pairs[w]
                left[:, new] += pairs[w]
        if moves <= clustered // 100:
            break
    return of


class Model:
    """What scoring needs in every task; of fixed size. ``of``: classes of the head words; ``table``: counts of class bigrams."""

    def __init__(self, head: list[bytes], counts: np.ndarray, of: np.ndarray, table: np.ndarray, n: int, v: int, tail: dict[int, tuple[int, int]]):
        many = len(table)
        self.step = np.log10((table + TRANSITION) / (table.sum(1, keepdims=True) + TRANSITION * many))
        self.end_known = END in set(head)
        #: By place; then the end, if training texts had none; then the tail's shapes.
        lone = np.zeros(1, np.int64)
        self.of = grouped(np.concatenate((of, lone)).astype(np.int64), many - SHAPES)
        own = np.concatenate((np.asarray(counts, float)[: len(head)], [0.0]))
        size = np.bincount(of, own[:-1], many) if len(of) else np.zeros(many)
        kinds = np.bincount(of, minlength=many) if len(of) else np.zeros(many)
        cls = self.of[: len(own)]
        self.emit = np.log10((own + EMISSION) / (size[cls] + EMISSION * np.maximum(kinds[cls], 1)))
        self.tail_size, self.tail_kinds = np.zeros(SHAPES), np.zeros(SHAPES)
        for s, (total, kind) in tail.items():
            self.tail_size[s], self.tail_kinds[s] = total, kind
        #: A tail word's emission is (count + EMISSION) over this; an unknown word's, too.
        self.tail_under = self.tail_size + EMISSION * (self.tail_kinds + 1)
        self.n, self.v = n, v
        self.base_under = n + 0.5 * (v + 1)
        self.base = np.log10((own + 0.5) / self.base_under)
        self.end = Places(head).of[END]


def score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, places) -> what the head alone gives."""
    worker_of("class model")
    for batch in batches:
        at = places_of(batch.column(2))
        if not batch.num_rows:
            continue
        ends = np.flatnonzero(at == model.end)
        starts = np.concatenate(([0], ends[:-1] + 1))
        cls = model.of[at]
        known, safe = at >= 0, np.maximum(at, 0)
        step = model.step[np.concatenate((cls[-1:], cls[:-1])), cls]
        score = np.add.reduceat(step + np.where(known, model.emit[safe], 0), starts)
        base = np.add.reduceat(np.where(known, model.base[safe], 0), starts)
        of_head = np.add.reduceat((known & ((at != model.end) | model.end_known)).astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - starts + 1), pa.array(of_head), pa.array(base), pa.array(score)], ["rid", "doc_id", "n_tokens", "known", "base", "score"])


def shape_column(word: Column) -> Column:
    """``shape`` of a binary column."""
    last = F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int")
    kind = F.when(last.between(97, 122) | (last >= 128), 0).when(last == 46, 1).when(last == 44, 2).when(last.between(48, 57), 3).otherwise(4)
    wide = F.hex(word).rlike("^(..)*[89A-F].")
    return F.when(wide, kind + 5).otherwise(kind)


def class_scores(docs: DataFrame, training: Column, clustered: int = CLUSTERED, classes: int = CLASSES, head_size: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities). ``training``: which rows to learn from."""
    train = id_and_bytes(docs.where(training))
    counts = staged(train.mapInArrow(count_batches, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    floor = count_floor(counts, head_size)
    rows = counts.where((F.col("n") >= floor) | (F.col("word") == F.lit(bytearray(END)))).toArrow()
    top = sorted(zip(rows["n"].to_pylist(), rows["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    head, own = [w for _, w in top], np.array([n for n, _ in top], np.int64)
    whole = counts.agg(F.sum("n"), F.count("*")).first()
    tail = counts.where((F.col("n") < floor) & (F.col("word") != F.lit(bytearray(END))))
    tail = tail.withColumn("shape", shape_column(F.col("word")))
    by_shape = {r["shape"]: (r["t"], r["k"]) for r in tail.groupBy("shape").agg(F.sum("n").alias("t"), F.count("*").alias("k")).collect()}
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    texts = staged(every.mapInArrow(lambda it: coded_batches(it, head), CODED), "coded")
    of, table = clustered_head(texts.where("train").select("ids"), head, clustered, classes, rounds)
    model = Model(head, own, of, table, whole[0] or 0, whole[1], by_shape)
    rows = texts.select("rid", "doc_id", "ids").mapInArrow(lambda it: score_batches(it, model), "rid bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double")
    under = F.array(*(F.lit(float(x)) for x in model.tail_under))
    words = texts.where("size(tail) > 0").select("rid", F.explode("tail").alias("word")).join(tail.select("word", "n"), "word", "left")
    words = words.select("rid", F.col("n").isNotNull().cast("long").alias("known"), F.coalesce("n", F.lit(0)).alias("n"), shape_column(F.col("word")).alias("shape"))
    parts = words.groupBy("rid").agg(
        F.sum("known").alias("tail_known"),
        F.sum(F.log10((F.col("n") + F.lit(0.5)) / F.lit(float(model.base_under)))).alias("tail_base"),
        F.sum(F.log10((F.col("n") + F.lit(EMISSION)) / F.get(under, F.col("shape")))).alias("tail_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.join(parts, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("tail_known")).alias("n_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("score") + zero("tail_score")).alias("score"),
    )
