"""Scores of texts by a causal self-attention model over subword ids, beside a word-count base.

Tokens are words, runs of anything but ASCII white space with A-Z in lower case, then one end. A word, after a space, is encoded by the ranks of
a public vocabulary, and its first id opens it. The probability of an id is that of its class times its share of the class (a softmax over all 50,000
ids would take some hundred times the work): the most frequent opening ids are classes of their own, the others fall in bands of like frequency.
The attention model reads the words before a token, each by
the embeddings of all its ids (attention.embed()), and gives the token's class; windows overlap, and each token is scored once. Within a
class a word is one of the most frequent words by its count, or else a run of ids by counts of pairs that follow each other in all other
words, with the shares that the training texts give the two.

Everything counted is counted over all training texts. The model starts from the counts of all pairs of classes that follow each other, an id's
embedding from the class of the words that it opens, and then takes ROUNDS steps; each is the gradient summed over all windows of a part of the
training texts, so that every window is read once and nothing depends on how rows lie in tasks, but for the rounding of sums. ``rate`` (1 unless asked for) is the share of texts whose windows are read.

Cases: null text counts as empty: only the end is scored; a null doc_id has no remainder, so it is learned from and not held out; rows that repeat
doc_id and text get equal scores but for rounding; with nothing to learn from all counts are 0 and the model keeps its start; an empty table gives no
rows; columns beyond doc_id and text are ignored.
"""

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .bpe import ENCODE_FILE, vocabulary_path
from .common import lean, materialize, table
from .langid import crc_mod
from .ngram_join import _blocks
from .ngrams import word_hashes

FOLDS, HELD = 7, 2
#: Classes of opening ids, the last of which is the end, and classes of the ids that follow, the last of which is a word's end.
SINGLES, BANDS = 239, 16
CLASSES = SINGLES + BANDS + 1
FOLLOW_SINGLES, FOLLOW_BANDS = 1000, 23
FOLLOW = FOLLOW_SINGLES + FOLLOW_BANDS + 1
#: Places in a word that pairs of ids are counted apart for; later ones count as the last.
PLACES = 3
#: Most frequent words that every task gets, each counted HEAD_LEAST times at least; the others' counts are looked up by a join. Words that
#: were never seen are like those others, so the rarest stay among them on a corpus of any size.
HEAD_WORDS, HEAD_LEAST = 1 << 18, 3
#: Steps of the training, the size of the first, and what the last one is of it.
ROUNDS, STEP, LAST_STEP = 12, 0.01, 0.2
MEMO_WORDS = 1 << 18
#: Places whose vectors and gradients are made at a time.
GROUP = 1 << 15
#: Name of the end among words.
END_WORD = -6148914691236517206


@functools.lru_cache(1)
def subwords(path: str):
    """(a function from texts to lists of ids, the number of ids)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("subwords", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, max(ranks.values()) + 1


def id_type(rows: int) -> str:
    """How ids below ``rows`` are written."""
    return "<u2" if rows <= 1 << 16 else "<u4"


def word_ids(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, each after a space, in one run, and where each word starts; one more start ends the last."""
    encode, _ = subwords(path)
    ids = [encode(" " + w.decode("utf-8", "replace")) for w in words]
    return np.array([i for x in ids for i in x], np.int64), np.cumsum([0, *map(len, ids)])


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _count(batches):
    """(w, word, c): the words of the texts of each batch, by hash, with their counts."""
    for batch in batches:
        held: list[tuple] = []
        docs = 0
        for _, texts in _blocks(batch, 0):
            docs += len(texts)
            hashes, spans = word_hashes(texts, spans=True)[::2]
            w, first, n = np.unique(hashes.view(np.int64), return_index=True, return_counts=True)
            buffer, starts, ends = spans
            held.append((w, [buffer[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], n))
        if not docs:
            continue
        w = np.concatenate([x for x, _, _ in held])
        w, first, at = np.unique(w, return_index=True, return_inverse=True)
        names = [x for _, names, _ in held for x in names]
        n = np.bincount(at, np.concatenate([n for _, _, n in held]), len(w)).astype(np.int64)
        yield _rows(w=np.append(w, END_WORD), word=pa.array([*(names[i] for i in first.tolist()), b"\n"], pa.binary()), c=np.append(n, docs))


def bands(counts: np.ndarray, singles: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each id, the most frequent alone and the others in n bands of like frequency, and the natural log of its share of its class."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    of = np.zeros(len(counts), np.int64)
    of[order[:singles]] = np.arange(min(singles, len(order)))
    mass = np.cumsum(counts[order[singles:]] + 0.5)
    if len(mass):
        of[order[singles:]] = singles + np.minimum((mass / mass[-1] * n).astype(int), n - 1)
    return of, np.log((counts + 0.5) / np.bincount(of, counts + 0.5, singles + n)[of]).astype(np.float32)


def _pair_keys(of: np.ndarray, follow: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id, the pair that it and its successor (or the word's end) make: (place * FOLLOW + first) * FOLLOW + second; and its word."""
    n = np.diff(starts)
    word = np.repeat(np.arange(len(n)), n)
    place = np.minimum(np.arange(len(ids)) - np.repeat(starts[:-1], n), PLACES - 1)
    second = np.append(follow[ids[1:]], 0)
    second[starts[1:] - 1] = FOLLOW - 1
    return (place * FOLLOW + follow[ids]) * FOLLOW + second, word


def _other(w: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether each word is not among ``head``, which is sorted."""
    return head[np.minimum(np.searchsorted(head, w), len(head) - 1)] != w if len(head) else np.ones(len(w), bool)


def _spelled(path: str, head: np.ndarray):
    """(c, rest, ids) of each word but the end, from rows (w, word, c): rest says that it is not among ``head``; ids are 32-bit integers."""

    def run(batches):
        for batch in batches:
            w = batch.column(0).to_numpy()
            some = np.flatnonzero(w != END_WORD)
            ids, starts = word_ids(path, [batch.column(1)[i].as_py() for i in some.tolist()])
            ids = ids.astype("<u4")
            yield _rows(c=batch.column(2).to_numpy()[some], rest=_other(w[some], head), ids=pa.array([ids[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary()))

    return run


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(c, rest, ids, starts) of a batch of _spelled()."""
    spelled = batch.column(2).to_pylist()
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(spelled), "<u4").astype(np.int64), np.cumsum([0, *(len(x) // 4 for x in spelled)])


def _id_counts(size: int):
    """(kind, key, n): opening ids of all words (0) and of other words than the most frequent (1), and following ids of the others (2)."""

    def run(batches):
        total = np.zeros((3, size))
        for batch in batches:
            c, rest, ids, starts = _runs(batch)
            total[0] += np.bincount(ids[starts[:-1]], c, size)
            total[1] += np.bincount(ids[starts[:-1]], c * rest, size)
            later = np.ones(len(ids), bool)
            later[starts[:-1]] = False
            total[2] += np.bincount(ids[later], np.repeat(c * rest, np.diff(starts))[later], size)
        kind, key = np.nonzero(total)
        yield _rows(kind=kind.astype(np.int32), key=key, n=total[kind, key].astype(np.int64))

    return run


def _pair_counts(of: np.ndarray, follow: np.ndarray):
    def run(batches):
        total = np.zeros(PLACES * FOLLOW * FOLLOW)
        for batch in batches:
            c, _, ids, starts = _runs(batch)
            if len(ids):
                key, word = _pair_keys(of, follow, ids, starts)
                found, at = np.unique(key, return_inverse=True)  # few of all pairs
                total[found] += np.bincount(at, c[word])
        key = np.flatnonzero(total)
        yield _rows(key=key, n=total[key].astype(np.int64))

    return run


class Words:
    """What the model holds of words: the class that opens a word and the log probability of the word within its class."""

    def __init__(self, model: dict):
        self.m, self.memo = model, {}
        self.type = np.dtype(id_type(len(model["of"]) + 1))

    def within(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Classes and natural log probabilities, as runs of ids, of words that are not among the most frequent, and the ids."""
        m = self.m
        ids, starts = word_ids(m["path"], words)
        first = ids[starts[:-1]]
        key, word = _pair_keys(m["of"], m["follow"], ids, starts)
        second = np.append(ids[1:], 0)
        log = m["pairs"][key] + np.where(key % FOLLOW == FOLLOW - 1, 0, m["follow_share"][second])
        spelled, cut = ids.astype(self.type).tobytes(), (starts * self.type.itemsize).tolist()
        return m["of"][first], m["first_share"][first] + np.bincount(word, log, len(words)), [spelled[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def look_up(self, hashes: np.ndarray, spans: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class and natural log probability within it of each word of a run, its place among the most frequent (-1 for others), its number of ids; all ids."""
        m = self.m
        head, buffer, starts, ends = m["words"], *spans
        at = np.minimum(np.searchsorted(head, hashes), max(0, len(head) - 1))
        there = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
        of, log = np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
        if there.any():
            of[there], log[there] = m["head_of"][at[there]], m["head_log"][at[there]]
        rest = np.flatnonzero(~there)
        w, first, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
        found = [self.memo.get(x) for x in w.tolist()]
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            places = rest[first[new]]
            c, p, spelled = self.within([buffer[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            p = p + m["tail_log"][c]
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            for i, x, y, z in zip(new, c.tolist(), p.tolist(), spelled, strict=True):
                found[i] = self.memo[int(w[i])] = (x, y, z)
        pool, begin, n = m["head_ids"], np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        if there.any():
            begin[there], n[there] = m["head_starts"][at[there]], np.diff(m["head_starts"])[at[there]]
        if len(rest):
            of[rest] = np.array([x for x, _, _ in found], np.int64)[back]
            log[rest] = np.array([y for _, y, _ in found])[back]
            sizes = np.array([len(z) for _, _, z in found]) // self.type.itemsize
            begin[rest], n[rest] = (len(pool) + np.cumsum(sizes) - sizes)[back], sizes[back]
            pool = np.concatenate([pool, np.frombuffer(b"".join(z for _, _, z in found), self.type)])
        ids = pool[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return of, log, np.where(there, at, -1), n, ids


def _read(model: dict):
    """(doc_id, row, held_out, n_tokens, known, logs, within, classes, ids, opens) of rows (doc_id, row, held_out, text).

    classes has a byte for each token, ids the end and then all ids of all words, opens a bit for each id: whether it opens a token.
    """

    def run(batches):
        words = Words(model)
        head, first = model["words"], np.array([len(model["of"])], words.type).tobytes()
        logs = np.log10(model["counts"] + 1.0)
        end = float(logs[np.searchsorted(head, END_WORD)]) if len(head) else 0.0
        for batch in batches:
            rows = []
            for _, texts in _blocks(batch, 3):
                hashes, bounds, spans = word_hashes(texts, spans=True)
                w = hashes.view(np.int64)
                of, within, at, n, ids = words.look_up(w, spans)
                cut = np.append(0, np.cumsum(n))
                opens = np.zeros(len(ids), bool)
                opens[cut[:-1]] = True
                there = at >= 0
                log = np.where(there, logs[at], 0.0) if len(head) else np.zeros(len(w))
                of = of.astype(np.uint8)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    i, j = int(cut[a]), int(cut[b])
                    spelled = first + ids[i:j].tobytes(), np.packbits(np.append(True, opens[i:j])).tobytes()
                    rows.append((b - a + 1, int(there[a:b].sum()) + (len(head) > 0), float(log[a:b].sum()) + end, float(within[a:b].sum()), of[a:b].tobytes() + bytes([CLASSES - 1]), *spelled))
            columns = [*zip(*rows, strict=True)] or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "row", "held_out", "n_tokens", "known", "logs", "within", "classes", "ids", "opens"])

    return run


def _bigrams(batches):
    """(key, n): how often each class follows each other, the end standing before a text; key is before * CLASSES + after."""
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            # texts close with the end, which so stands before the next
            x = np.frombuffer(bytes([CLASSES - 1]) + b"".join(batch.column(0).slice(i, 256).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(x[:-1] * CLASSES + x[1:], minlength=len(total))
    key = np.flatnonzero(total)
    yield _rows(key=key, n=total[key])


def first_weights(pairs: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights that start at the classes' frequencies and the main directions of what one class says of the next; the attention starts small."""
    pairs = pairs + 0.5
    after = pairs.sum(0) / pairs.sum()
    before = pairs.sum(1, keepdims=True)
    given = (pairs + 50 * after) / (before + 50)
    weight = np.sqrt(before / before.sum())
    u, size, v = np.linalg.svd(weight * np.log(given / after), full_matrices=False)
    turn = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])  # else signs are arbitrary
    k = min(attention.DIM, len(size))
    p = attention.start(CLASSES, after, seed)
    scale = np.sqrt(size[:k])
    p["emb"] = np.zeros_like(p["emb"])
    p["emb"][:, :k] = u[:, :k] * turn[:k] / weight * scale
    p["pos"] *= 0
    p["w1"] *= 0
    for i in range(k):
        p["w1"][i, 2 * i], p["w1"][i, 2 * i + 1] = 1, -1
        p["w2"][2 * i], p["w2"][2 * i + 1] = v[i] * turn[i] * scale[i], -v[i] * turn[i] * scale[i]
    rng = np.random.default_rng(seed)
    p["w1"] += 0.02 * rng.standard_normal(p["w1"].shape)
    return {name: x.astype(np.float32) for name, x in p.items()}


def id_weights(p: dict[str, np.ndarray], of: np.ndarray, opened: np.ndarray) -> dict[str, np.ndarray]:
    """first_weights() with embeddings of ids and, last, of the end: those of the classes of ids that open words, 0 for others."""
    return p | {"emb": np.concatenate([p["emb"][of] * (opened > 0)[:, None], p["emb"][-1:]]).astype(np.float32)}


def _plain(classes: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
    """(classes, ids, opens) of texts whose words have one id each, the number of their class."""
    return [(x, np.frombuffer(bytes([CLASSES - 1]) + x[:-1], np.uint8).astype(id_type(CLASSES)).tobytes(), np.packbits(np.ones(len(x), bool)).tobytes()) for x in classes]


def _texts(batch: pa.RecordBatch) -> list[tuple[bytes, bytes, bytes]]:
    columns = [batch.column(k).to_pylist() for k in ("classes", "ids", "opens") if k in batch.schema.names]
    return [*zip(*columns, strict=True)] if len(columns) == 3 else _plain(columns[0])


def _groups(texts: list[tuple[bytes, bytes, bytes]], rows: int, stride: int):
    """(ids, starts of places in ids, windows) of GROUP places or some more at a time, where ``rows`` ids have embeddings.

    windows: up to BATCH at a time, (places to read, classes to give, mask of those to count, number of the text of each window).
    """
    attention.keep_memory()
    kind = np.dtype(id_type(rows))
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and size < GROUP:
            size += len(texts[last][0])
            last += 1
        ids = np.frombuffer(b"".join(x for _, x, _ in texts[first:last]), kind)
        opens = [np.unpackbits(np.frombuffer(y, np.uint8), count=len(x) // kind.itemsize) for _, x, y in texts[first:last]]
        classes = np.frombuffer(b"".join(x for x, _, _ in texts[first:last]), np.uint8)
        held, base = [], 0
        place = np.arange(attention.WINDOW)
        for i in range(first, last):
            n = len(texts[i][0])
            inputs, targets, begin, end = attention.windows(np.arange(base, base + n + 1), stride)
            held.append((np.minimum(inputs, base + n - 1), classes[targets - 1], (place >= begin[:, None]) & (place < end[:, None]), np.full(len(inputs), i)))
            base += n
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield ids, np.flatnonzero(np.concatenate(opens)), [tuple(c[k : k + attention.BATCH] for c in whole) for k in range(0, len(whole[0]), attention.BATCH)]
        first = last


def _gradients(flat: np.ndarray):
    """(slot, g0, g1, ...): the sums of gradients over all windows, without overlap, of rows (classes, ids, opens), DIM to a row; slot -1 has the number of tokens."""

    def run(batches):
        p = attention.unpack(flat, CLASSES)
        emb, others, count = np.zeros(p["emb"].shape), 0, 0
        for batch in batches:
            for ids, starts, windows in _groups(_texts(batch), len(emb), attention.WINDOW):
                x = attention.embed(p["emb"], ids, starts)
                dx = np.zeros_like(x)
                for inputs, targets, some, _ in windows:
                    g = attention.step(p, inputs, targets, some.astype(np.float32), x)[1]
                    n = int(some.sum())  # step() gives means
                    dx[inputs[some]] = g["x"][some] * n
                    others = others + np.concatenate([g[k].ravel() for k in attention.NAMES[1:]]).astype(np.float64) * n
                    count += n
                attention.embed_back(ids, starts, dx, emb)
        if count:
            total = np.concatenate([emb.ravel(), others]).reshape(-1, attention.DIM)
            slot = np.flatnonzero(total.any(1))
            values = np.concatenate([total[slot], np.full((1, attention.DIM), count)]).T
            yield _rows(slot=np.append(slot, -1), **dict(zip(_VALUES, np.ascontiguousarray(values), strict=True)))

    return run


_VALUES = [f"g{i}" for i in range(attention.DIM)]


def train(texts: DataFrame, start: dict[str, np.ndarray], rate: float = 1.0) -> np.ndarray:
    """Weights after ROUNDS steps from ``start``, over rows (row, classes) or (row, classes, ids, opens); row, a hash, deals texts to rounds.

    Rows that are written in order of rounds may have it as a column.
    """
    p = {k: x.astype(np.float64) for k, x in start.items()}
    adam = attention.Adam(p, STEP)
    texts = texts if "round" in texts.columns else texts.withColumn("round", _round("row"))
    kind = ", ".join(["slot long", *(f"{k} double" for k in _VALUES)])
    for k in range(ROUNDS):
        own = texts.filter(F.col("round") == k)
        own = own if rate >= 1 else own.filter(_share("row") < rate * (ROUNDS << 20))
        own = own.select(*(c for c in ("classes", "ids", "opens") if c in texts.columns))
        sums = own.mapInArrow(_gradients(attention.pack(p).astype(np.float32)), kind).groupBy("slot").agg(*(F.sum(k).alias(k) for k in _VALUES)).toArrow()
        if sums.num_rows:
            slot, values = sums["slot"].to_numpy(), np.stack([sums[k].to_numpy() for k in _VALUES], 1)
            flat = np.zeros((sum(x.size for x in p.values()) // attention.DIM, attention.DIM))
            flat[slot[slot >= 0]] = values[slot >= 0] / values[slot < 0][0, 0]
            flat, at, g = flat.ravel(), 0, {}
            for name in attention.NAMES:
                g[name] = flat[at : at + p[name].size].reshape(p[name].shape)
                at += p[name].size
            adam.rate = STEP * (1 + (LAST_STEP - 1) * k / max(1, ROUNDS - 1))
            adam.update(g)
    return attention.pack(p).astype(np.float32)


def _share(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(ROUNDS << 20))


def _round(row: str) -> Column:
    """The round that a row is read in."""
    return (_share(row) % ROUNDS).cast("int")


def fit(train: DataFrame, path: str) -> dict:
    """The model, and as ``table`` the counts (w, c) of all words, from rows with text as binary."""
    counts = train.select("text").mapInArrow(lean(_count), "w long, word binary, c long")
    words = materialize(counts.groupBy("w").agg(F.first("word").alias("word"), F.sum("c").alias("c")))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.filter((F.col("c") >= HEAD_LEAST) | (F.col("w") == END_WORD)).orderBy(F.desc("c"), "w").limit(HEAD_WORDS).toArrow().sort_by("w")
    head, head_counts = top["w"].to_numpy(), top["c"].to_numpy()
    _, size = subwords(path)
    ids = np.zeros((3, size))
    spelled = materialize(words.mapInArrow(lean(_spelled(path, head)), "c long, rest boolean, ids binary"))
    found = spelled.mapInArrow(_id_counts(size), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    ids[found["kind"].to_numpy(), found["key"].to_numpy()] = found["n"].to_numpy()
    of, _ = bands(ids[0], SINGLES, BANDS)
    follow, follow_share = bands(ids[2] + ids[1] * 1e-3, FOLLOW_SINGLES, FOLLOW_BANDS)
    model = {"path": path, "n": int(total["n"]), "v": int(total["v"]), "table": words.select("w", "c"), "words": head, "counts": head_counts, "of": of, "follow": follow, "follow_share": follow_share}
    model["first_share"] = np.log((ids[1] + 0.05) / np.bincount(of, ids[1] + 0.05, CLASSES)[of]).astype(np.float32)
    pairs = np.zeros(PLACES * FOLLOW * FOLLOW)
    found = spelled.filter("rest").mapInArrow(_pair_counts(of, follow), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    pairs[found["key"].to_numpy()] = found["n"].to_numpy()
    del found
    pairs = pairs.reshape(PLACES, FOLLOW, FOLLOW)
    alone = (pairs.sum((0, 1)) + 0.1) / (pairs.sum() + 0.1 * FOLLOW)
    any_place = (pairs.sum(0) + 4 * alone) / (pairs.sum((0, 1 + 1))[:, None] + 4)
    model["pairs"] = np.log((pairs + 4 * any_place) / (pairs.sum(2, keepdims=True) + 4)).astype(np.float32).ravel()
    # within a class: the most frequent words by count, the others by ids
    end = head == END_WORD
    first, starts = word_ids(path, top["word"].to_pylist())
    model["head_ids"], model["head_starts"], model["opened"] = first.astype(id_type(size + 1)), starts, ids[0]
    head_of = np.where(end, CLASSES - 1, of[first[starts[:-1]]] if len(head) else 0)
    of_head = np.bincount(head_of, head_counts, CLASSES)
    of_tail = np.bincount(of, ids[1], CLASSES)
    both = np.maximum(of_head + of_tail, 1e-9)
    tail = (of_tail + 0.5) / (both + 1)
    model["tail_log"] = np.log(tail)
    model["head_of"], model["head_log"] = head_of, np.log(head_counts / np.maximum(of_head[head_of], 1)) + np.log1p(-tail[head_of])
    if end.any():
        model["head_log"][end] = 0.0
    return model


def _sent(model: dict) -> dict:
    """The part of a model that tasks get."""
    return {k: v for k, v in model.items() if k not in ("table", "opened")}


def score_texts(p: dict, classes: list[bytes]) -> np.ndarray:
    """Natural log probabilities of texts' classes, the end's included, where classes are read as they are."""
    return score_words(p, _plain(classes))


def score_words(p: dict, texts: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """Natural log probabilities of the classes, the end's included, of texts (classes, ids, opens)."""
    out = np.zeros(len(texts))
    for ids, starts, windows in _groups(texts, len(p["emb"]), attention.STRIDE):
        x = attention.embed(p["emb"], ids, starts)
        for inputs, targets, some, of in windows:
            logs = attention.log_probabilities(p, inputs, targets, some, x)
            out += np.bincount(np.repeat(of, some.sum(1)), logs, len(texts))
    return out


def _score(flat: np.ndarray):
    """Rows with score instead of within, classes, ids and opens."""

    def run(batches):
        p = attention.unpack(flat, CLASSES)
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(i, 256)
                value = (score_words(p, _texts(part)) + part.column(6).to_numpy()) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(6)), pa.array(value)], names=["doc_id", "row", "held_out", "n_tokens", "known", "logs", "score"])

    return run


def _tail(words: np.ndarray):
    """(row, w, tf) of the distinct words of each text that are not among ``words``."""

    def run(batches):
        for batch in batches:
            for first, texts in _blocks(batch, 1):
                hashes, bounds = word_hashes(texts)
                w = hashes.view(np.int64)
                rest = _other(w, words)
                text = np.repeat(np.arange(len(texts)), np.diff(bounds))[rest]
                w = w[rest]
                order = np.lexsort((w, text))
                text, w = text[order], w[order]
                new = np.append(True, (text[1:] != text[:-1]) | (w[1:] != w[:-1]))[: len(w)]
                at = np.flatnonzero(new)
                row = np.array(batch.column(0).slice(first, len(texts)).to_pylist(), np.int64)
                yield _rows(row=row[text[at]], w=w[at], tf=np.diff(np.append(at, len(w))).astype(np.int32))

    return run


def score(docs: DataFrame, path: str, rate: float = 1.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rate is that of train()."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit("")).cast("binary")
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), held.alias("held_out"), text.alias("text"))
    model = fit(rows.filter(~F.col("held_out")), path)
    common = f"doc_id {kind}, row long, held_out boolean, n_tokens long, known long, logs double"
    read = rows.mapInArrow(lean(_read(_sent(model))), common + ", within double, classes binary, ids binary, opens binary")
    # a file for each task, in order of rounds: a folder for each round would be thirteen files, each of which Hadoop's local file system changes the mode of by a process of its own
    read = materialize(read.withColumn("round", F.when(F.col("held_out"), F.lit(ROUNDS)).otherwise(_round("row"))).sortWithinPartitions("round"))
    learned = read.filter(F.col("round") < ROUNDS)
    pairs = np.zeros(CLASSES * CLASSES)
    for r in learned.select("classes").mapInArrow(_bigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        pairs[r["key"]] = r["n"]
    flat = train(learned, id_weights(first_weights(pairs.reshape(CLASSES, CLASSES)), model["of"], model["opened"]), rate)
    scored = materialize(read.drop("round").mapInArrow(_score(flat), common + ", score double"))
    tail = rows.select("row", "text").mapInArrow(_tail(model["words"]), "row long, w long, tf int")
    others = tail.join(model["table"], "w").groupBy("row").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("tail_logs"))
    # rows that repeat each add to a sum, which is shared among them
    times = scored.groupBy("row").agg(F.count("*").alias("times"))
    out = scored.join(others.join(times, "row"), "row", "left")
    known = F.col("known") + F.coalesce((F.col("tail_known") / F.col("times")).cast("long"), F.lit(0))
    logs = F.col("logs") + F.coalesce(F.col("tail_logs") / F.col("times"), F.lit(0.0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(model["n"] + model["v"] + 1)))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), vocabulary_path(ENCODE_FILE))
