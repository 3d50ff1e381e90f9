"""
Language-model scoring by Katz backoff: Good-Turing discounted counts of n-grams up to an order, with backoff weights that
make each history's probabilities sum to one exactly.

Counts live in tables partitioned by hash. Texts are dealt once, as packed blocks. A block asks each table partition for
the counts of its own distinct words, then of its distinct pairs, and so on up to the order, and gets its answers in the
order it asked, so nothing but hashes, counts and the probabilities of shorter histories moves. A history with more than a 4T-th of all tokens (T partitions, hence at most 4T such
histories) is salted by its successors, over as many partitions as it has such shares; its sums are added up from those in
a table, which is joined with the histories that each block asked about. Successors of one history are told apart by 48
bits: of a million of them two are taken for one with a probability of 0.2 %.

The vocabulary is the training words, the end, and one class for every other word. P(w) is the discounted share of w;
what discounting frees is the unknown class's. P(w|h) is the discounted share of (h, w) among the n-grams from h, or
a(h) P(w|h') for one not seen, h' being h without its first word, with a(h) = (1 - sum of seen P(.|h)) / (1 - sum of P(.|h')
of those successors). Where a history frees nothing (no successor counted rarely enough), one pretended token is kept back
for its unseen successors. Before a text stand as many start marks as a history has words.

Nulls and empty texts have the end only. Rows are scored one by one, so repeated rows get equal scores and count as often
as they stand in the training rows. An empty table, or no training rows, gives N = 0: every token is of the unknown class.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, block_count, cuts, fold, id_and_text, mixed, packed, packed_blocks, stored, target_count, unpacked

#: Counts above this are not discounted.
TRUSTED = 5
TRAIN_MODULUS = 10
END, START = U64(1), U64(2)
MIX = U64(0x9E3779B97F4A7C15)
LOW48 = U64(2**48 - 1)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case (A-Z only), then the end."""
    words = text.encode().lower().split() if text else []
    out = np.empty(len(words) + 1, U64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    out[-1] = END
    return out


def falling_law(of_counts: dict[int, int]) -> float:
    """
    Slope of the log-linear fit of counts of counts over all r (simple Good-Turing): n(r) is spread over half the way
    between the counts next to r, so that gaps among large counts weigh as much as they should.
    """
    r = np.array(sorted(of_counts), np.float64)
    n = np.array([of_counts[int(x)] for x in r], np.float64)
    below, above = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - (r[-2] if len(r) > 1 else 0))
    return float(np.polyfit(np.log(r), np.log(2 * n / (above - below)), 1)[0])


def discounts(of_counts: dict[int, int], trusted: int = TRUSTED) -> np.ndarray:
    """
    Good-Turing factors by count, 0 to `trusted` + 1 (the last is 1, for all larger counts). From the published formula
    (r*/r - c) / (1 - c) with r* = (r+1) n(r+1) / n(r) and c = (k+1) n(k+1) / n(1). Groups of copies swell single n(r) and
    make factors leave (0, 1]; then all n(r) in the formula come from the fit of falling_law(), which keeps every factor
    in (0, 1) as long as its slope is below -1. Only where counts of counts follow no falling law (not n(1) > n(2) > 0, or
    a slope of -1 or more) does absolute discounting by n(1) / (n(1) + 2 n(2)) take the place of them all.
    """
    n = [of_counts.get(r, 0) for r in range(trusted + 2)]
    out = np.ones(trusted + 2)

    def good_turing(n) -> list[float]:
        c = (trusted + 1) * n[trusted + 1] / n[1]
        return [((r + 1) * n[r + 1] / n[r] / r - c) / (1 - c) if n[r] and c < 1 else -1.0 for r in range(1, trusted + 1)]

    if n[1]:
        good = good_turing(n)
        if not all(0 < d <= 1 for d in good) and n[1] > n[2] > 0:
            slope = falling_law(of_counts)
            good = good_turing([0.0, *[r**slope for r in range(1, trusted + 2)]])
        out[1:-1] = good if all(0 < d <= 1 for d in good) else [(r - n[1] / (n[1] + 2 * n[2])) / r if n[2] else (r - 0.5) / r for r in range(1, trusted + 1)]
    return out


@dataclass
class Shares:
    """Probabilities of words from their counts; the unknown class has what is left."""

    total: int
    vocabulary: int
    factor: np.ndarray
    unknown: float
    divisor: float

    @staticmethod
    def of(total: int, vocabulary: int, of_counts: dict[int, int]) -> Shares:
        factor = discounts(of_counts)
        kept = total - sum((1 - factor[r]) * r * n for r, n in of_counts.items() if r <= TRUSTED)
        divisor = float(total) if total - kept > 1e-9 * max(total, 1) else total + 1.0
        return Shares(total, vocabulary, factor, 1 - kept / divisor if total else 1.0, divisor)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return self.factor[np.minimum(counts, TRUSTED + 1)] * counts / self.divisor if self.total else np.zeros(len(counts))


def _pairs_of(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's tokens by document, and whether each document is a training one."""
    return [tokens(x.as_py()) for x in rows.column("c1")], ~rows.column("c2").to_numpy(zero_copy_only=False).astype(bool)


def _distinct(docs: list[np.ndarray], train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words, START among them, in order; their counts in training texts (START: the texts); tokens by place."""
    sizes = [len(d) for d in docs]
    values, inverse = np.unique(np.concatenate([*docs, np.full(len(docs), START, U64)]), return_inverse=True)
    weight = np.concatenate([np.repeat(train, sizes), train])
    return values, np.bincount(inverse, weight, len(values)).astype(np.int64), inverse


def _narrow(x: np.ndarray) -> bytes:
    """Counts as bytes of the least width, named by the first byte."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)


def _pack_sums(x: np.ndarray) -> bytes:
    """The sum of P(w) in full, the counts narrowed."""
    return pickle.dumps((x[:, 1].tobytes(), [_narrow(x[:, i].astype(np.int64)) for i in range(x.shape[1]) if i != 1]))


def _unpack_sums(x: bytes) -> np.ndarray:
    lower, counts = pickle.loads(x)
    columns = [_wide(c).astype(np.float64) for c in counts]
    return np.stack([columns[0], np.frombuffer(lower, np.float64), *columns[1:]], 1)


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _ask_words(targets: int):
    def ask(left: pa.Table) -> pa.Table:
        values, counts, _ = _distinct(*_pairs_of(unpacked(left.column("payload"))))
        at, block = cuts(values, targets), left.column("block")[0].as_py()
        return _rows(["target", "block", "words", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()], [(t, block, packed(values[a:b]), _narrow(counts[a:b])) for t, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a])

    return ask


def _histogram(counts: np.ndarray) -> bytes:
    """The distinct counts, then how many have each."""
    return packed(np.stack(np.unique(counts, return_counts=True)).astype(np.int64))


def _answer_words(asked: pa.Table) -> pa.Table:
    """To each block its words' counts over all training texts; in the row of block -1, sums over this partition."""
    values = [np.frombuffer(x.as_buffer(), U64) for x in asked.column("words")]
    distinct, inverse = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([_wide(x.as_py()) for x in asked.column("counts")]), len(distinct)).astype(np.int64)
    parts = np.split(total[inverse], np.cumsum([len(v) for v in values])[:-1])
    target = asked.column("target")[0].as_py()
    words = total[(distinct != START) & (total > 0)]
    rows = [(b.as_py(), target, _narrow(p), 0, 0, b"") for b, p in zip(asked.column("block"), parts, strict=True)]
    rows.append((-1, target, b"", int(words.sum()), len(words), _histogram(words)))
    return _rows(["block", "target", "counts", "total", "distinct", "histogram"], [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()], rows)


def _in_order(answers: pa.Table, column: str, by: str = "target") -> list[bytes]:
    order = np.argsort(answers.column(by).to_numpy())
    values = answers.column(column)
    return [values[int(i)].as_py() for i in order]


@dataclass
class Learnt:
    """What is known of the corpus so far; histories of more than `hot` tokens are salted. `factors`: by level, from pairs on."""

    shares: Shares
    hot: float
    targets: int
    factors: list[np.ndarray]


class _Level:
    """A block's distinct n-grams of one length, as places of their histories and words, and where each is kept."""

    def __init__(self, below: _Level | None, block: _Block, learnt: Learnt):
        words, starts = block.words, block.starts[:-1]
        before = block.token if below is None else below.gram
        history = np.empty_like(before)
        history[1:] = before[:-1]
        history[starts] = np.searchsorted(words, START) if below is None else len(below.h)
        keys, first, self.gram = np.unique(history * len(words) + block.token, return_index=True, return_inverse=True)
        self.h, self.w = np.divmod(keys, len(words))
        #: of each n-gram the one with a shorter history: a word, or an n-gram of the level below
        self.lower = before[first]
        # of each history its hash and its count
        marks = words if below is None else np.append(below.hashes, mixed(START + U64(below.n)))
        counts = block.count if below is None else np.append(below.count, block.n_train)
        self.n = 1 if below is None else below.n + 1
        self.history = marks[self.h]
        self.hashes = mixed(self.history * MIX + words[self.w] + U64(self.n))
        self.hot = counts[self.h] > learnt.hot
        salts = np.maximum(np.ceil(counts / learnt.hot), 1).astype(U64)[self.h]
        # n-grams are kept with their history, or with a share of its successors if it is hot
        route = mixed(self.history + mixed(words[self.w]) % salts * MIX) % U64(learnt.targets)
        self.order = np.argsort(route, kind="stable")
        route = route[self.order].astype(np.int64)
        self.at = np.searchsorted(route, np.arange(learnt.targets + 1))
        own = self.h[self.order]
        self.begins = np.ones(len(own), bool)
        self.begins[1:] = (own[1:] != own[:-1]) | (route[1:] != route[:-1])

    def answered(self, answers: pa.Table, salted: pa.Table, lower: np.ndarray, factor: np.ndarray) -> None:
        """Counts, and probabilities from those with shorter histories."""
        self.count = np.empty(len(self.h), np.int64)
        self.count[self.order] = np.concatenate([_wide(x) for x in _in_order(answers, "counts")])
        sums = np.concatenate([_unpack_sums(x) for x in _in_order(answers, "sums")])
        first = self.order[self.begins]
        own = np.flatnonzero(self.hot[first])
        if len(own):
            h = salted.column("h").to_numpy().view(U64)
            order = np.argsort(h)
            parts = np.stack(salted.column("s").to_pylist())
            sums[own] = parts[order[np.searchsorted(h[order], self.history[first[own]])]]
        divisor, weight = _backoff(sums, factor)
        group = np.empty(len(self.h), np.int64)
        group[self.order] = np.cumsum(self.begins) - 1
        seen = factor[np.minimum(self.count, TRUSTED + 1)] * self.count / np.maximum(divisor, 1e-300)[group]
        self.p = np.where(self.count > 0, seen, weight[group] * lower[self.lower])


def _backoff(sums: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divisor of each history's counts, and its backoff weight."""
    total, lower, by_count, successors = sums[:, 0], sums[:, 1], sums[:, 2 : 2 + TRUSTED], sums[:, -1]
    freed = by_count @ ((1 - factor[1:-1]) * np.arange(1, TRUSTED + 1))
    divisor = np.where(freed > 1e-9 * total, total, total + 1)
    rest = np.where(freed > 1e-9 * total, freed, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(successors > 0, rest / divisor / np.maximum(1 - lower, 1e-300), 1.0)
    return divisor, weight


class _Block:
    """What each step on a block works out anew from its texts and from the answers so far, level by level up to `levels`."""

    def __init__(self, left: pa.Table, right: pa.Table, learnt: Learnt, levels: int):
        rows = unpacked(left.column("payload"))
        docs, self.train = _pairs_of(rows)
        self.ids, self.n_train = rows.column("c0"), int(self.train.sum())
        self.words, _, inverse = _distinct(docs, self.train)
        self.starts = np.cumsum([0, *map(len, docs)])
        self.token = inverse[: self.starts[-1]]
        answers = lambda level, salted: right.filter(pa.compute.and_(pa.compute.equal(right.column("level"), level), pa.compute.equal(right.column("salted"), salted)))
        self.count = np.concatenate([_wide(x) for x in _in_order(answers(0, False), "counts")])
        self.n_train = int(self.count[np.searchsorted(self.words, START)])
        self.level, lower = None, np.where(self.count > 0, learnt.shares.p(self.count), learnt.shares.unknown)
        for n in range(1, levels + 1):
            self.level, self.lower = _Level(self.level, self, learnt), lower
            if n <= len(learnt.factors):
                self.level.answered(answers(n, False), answers(n, True), lower, learnt.factors[n - 1])
                lower = self.level.p

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.level.gram, np.repeat(self.train, np.diff(self.starts)), len(self.level.h)).astype(np.int64)


def _ask(n: int, learnt: Learnt):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["target", "block", "histories", "hot", "sizes", "words", "lower", "counts"], [pa.int32(), pa.int32()] + [pa.binary()] * 6
        if not left.num_rows:
            return _rows(names, kinds, [])
        b = _Block(left, right, learnt, n)
        counts, block, out, level = b.training_counts(), left.column("block")[0].as_py(), [], b.level
        for t in range(learnt.targets):
            own = level.order[level.at[t] : level.at[t + 1]]
            if not len(own):
                continue
            begins = np.flatnonzero(level.begins[level.at[t] : level.at[t + 1]])
            first = own[begins]
            sizes = np.diff(np.append(begins, len(own)))
            low = (b.words[level.w[own]] & LOW48).view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits tell apart the successors of one history
            lower = _narrow(b.count[level.w[own]]) if n == 1 else packed(b.lower[level.lower[own]])  # words' counts are less to send
            out.append((t, block, packed(level.history[first]), packed(level.hot[first]), _narrow(sizes), packed(low), lower, _narrow(counts[own])))
        return _rows(names, kinds, out)

    return ask


def _answer(n: int, shares: Shares):
    def answer(asked: pa.Table) -> pa.Table:
        """
        To each block the counts of its n-grams, and for each history it asked about: the successors' training total, by
        count up to TRUSTED the number of successors (what discounts need), and the sum of their P(w|h'); of salted ones only
        this partition's part, and which they are. In the row of block -1: the parts of all salted histories.
        """
        histories, words, lowers, counts, lengths, groups, hot = [], [], [], [], [], [], []
        for i in range(asked.num_rows):
            first, sizes = np.frombuffer(asked.column("histories")[i].as_buffer(), U64), _wide(asked.column("sizes")[i].as_py())
            low = np.zeros((int(sizes.sum()), 8), np.uint8)
            low[:, :6] = np.frombuffer(asked.column("words")[i].as_buffer(), np.uint8).reshape(-1, 6)
            histories.append(np.repeat(first, sizes))
            words.append(low.view(U64).ravel())
            lower = asked.column("lower")[i]
            lowers.append(shares.p(_wide(lower.as_py())) if n == 1 else np.frombuffer(lower.as_buffer(), np.float64))
            counts.append(_wide(asked.column("counts")[i].as_py()))
            lengths.append(len(low))
            groups.append(first)
            hot.append(first[np.frombuffer(asked.column("hot")[i].as_buffer(), bool)])
        h, w, p, c = map(np.concatenate, (histories, words, lowers, counts))
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(c[order], at)
        back = np.empty(len(h), np.int64)
        back[order] = total[np.cumsum(new) - 1]
        h, low, seen = h[at], p[order][at], total > 0
        own, inverse = np.unique(h, return_inverse=True)
        cols = [np.bincount(inverse, total, len(own)), np.bincount(inverse, low * seen, len(own))]
        cols += [np.bincount(inverse, (total == r).astype(float), len(own)) for r in range(1, TRUSTED + 1)]
        cols.append(np.bincount(inverse, seen.astype(float), len(own)))
        sums = np.stack(cols, 1)
        ends = np.cumsum(lengths)[:-1]
        target = asked.column("target")[0].as_py()
        rows = [(b.as_py(), target, _narrow(p), _pack_sums(sums[np.searchsorted(own, g)]), packed(s), b"") for b, p, g, s in zip(asked.column("block"), np.split(back, ends), groups, hot, strict=True)]
        salted = np.unique(np.concatenate(hot))
        rows.append((-1, target, b"", _pack_sums(sums[np.searchsorted(own, salted)]), packed(salted), _histogram(total[seen])))
        return _rows(["block", "target", "counts", "sums", "salted", "histogram"], [pa.int32(), pa.int32(), *[pa.binary()] * 4], rows)

    return answer


def _score(learnt: Learnt):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORED.empty_table()
        b, shares = _Block(left, right, learnt, len(learnt.factors)), learnt.shares
        base = np.log10((b.count + 0.1) / (shares.total + 0.1 * (shares.vocabulary + 1)))
        at, known, own = b.starts[:-1], (b.count > 0)[b.token], np.log10(b.level.p)
        columns = [b.ids, ~b.train, np.diff(b.starts), np.add.reduceat(known.astype(np.int64), at), np.full(len(at), shares.total), np.add.reduceat(base[b.token], at), np.add.reduceat(own[b.level.gram], at)]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED)

    return score


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, train_modulus: int = TRAIN_MODULUS, salt_over: float | None = None, order: int = 2) -> DataFrame:
    """
    Learns n-grams of up to `order` (2 at least) words from the rows with fold(train_modulus) > 0 and scores all. Histories
    of more than `salt_over` tokens are salted. See SCHEMA.
    """
    plain = id_and_text(docs)
    plain = plain.withColumn("held_out", fold(train_modulus) == 0)
    n_blocks = block_count(plain)
    targets = target_count(n_blocks, 1)
    blocks = packed_blocks(plain, n_blocks)
    asked = blocks.groupBy("block").applyInArrow(_ask_words(targets), "target int, block int, words binary, counts binary")
    words = stored(asked.repartition(targets, "target").groupBy("target").applyInArrow(_answer_words, "block int, target int, counts binary, total long, distinct long, histogram binary"), "words")
    facts = words.where("block < 0")
    total, distinct = facts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    shares = Shares.of(total, distinct, _of_counts(facts))
    learnt = Learnt(shares, max(shares.total / (4 * targets), 1000) if salt_over is None else salt_over, targets, [])
    answers = _told(words.where("block >= 0"), 0, False)
    for n in range(1, order):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask(n, learnt), "target int, block int, histories binary, hot binary, sizes binary, words binary, lower binary, counts binary")
        grams = stored(asked.repartition(targets, "target").groupBy("target").applyInArrow(_answer(n, shares), "block int, target int, counts binary, sums binary, salted binary, histogram binary"), f"grams-{n + 1}")
        own, others = grams.where("block < 0"), grams.where("block >= 0")
        salted = _histories(others).join(stored(_salted_sums(own), "salted"), "h")
        answers = answers.unionByName(_told(others.drop("salted"), n, False)).unionByName(_told(salted, n, True))
        learnt = Learnt(shares, learnt.hot, targets, [*learnt.factors, discounts(_of_counts(own))])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(learnt), SCHEMA)


def _told(answers: DataFrame, level: int, salted: bool) -> DataFrame:
    """Answers of any kind as rows of one shape."""
    kinds = {"target": "int", "counts": "binary", "sums": "binary", "h": "long", "s": "array<double>"}
    columns = [F.col(c) if c in answers.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    return answers.select("block", F.lit(level).alias("level"), F.lit(salted).alias("salted"), *columns)


def _of_counts(own: DataFrame) -> dict[int, int]:
    """Counts of counts over all partitions. N tokens have less than sqrt(2N) distinct counts."""

    def parts(batches):
        for b in batches:
            for x in b.column("histogram"):
                r, n = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n)], names=["r", "n"])

    found = own.select("histogram").mapInArrow(parts, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()
    return {x.r: x.n for x in found}


def _histories(answers: DataFrame) -> DataFrame:
    """(block, h): the salted histories that each block asked about."""

    def parts(batches):
        for b in batches:
            h = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in h])), pa.array(np.concatenate(h))], names=["block", "h"])

    return answers.where(F.octet_length("salted") > 0).select("block", "salted").mapInArrow(parts, "block int, h long").distinct()


def _salted_sums(own: DataFrame) -> DataFrame:
    """(h, s): sums of the salted histories, added up over the partitions that had parts of them."""

    def parts(batches):
        for b in batches:
            for salted, sums in zip(b.column(0), b.column(1), strict=True):
                h, s = np.frombuffer(salted.as_buffer(), np.int64), _unpack_sums(sums.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(h), *[pa.array(s[:, i]) for i in range(s.shape[1])]], names=["h", *names])

    names = [f"s{i}" for i in range(TRUSTED + 3)]
    rows = own.where(F.octet_length("salted") > 0).select("salted", "sums").mapInArrow(parts, "h long, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("h").agg(F.array(*[F.sum(n) for n in names]).alias("s"))


def op3_katz_lm(spark, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
