"""SentencePiece encoding and decoding of byte-pair models, by rounds of merges over flat arrays.

The words of a batch of texts that no table holds yet stand one after the other in one array of symbols. A round finds the least rank of a pair in each
word by a segmented minimum, merges its leftmost places in all words at once, closes the gaps and takes out the words without a pair; it ends when
none is left. Places of a word merge in one round from the left up to the first after which a pair of the same or a better rank arises, which must
go first; places further away than pieces are long don't wait for each other. So a round gives what one merge after another would.

Words are cut where no piece goes across, at white space and inside long words. Runs of one character whose pieces all have the same, last score (white
space in many vocabularies) come after all other merges and are put together from the left.

Cases: null text counts as empty: begin and end only, and the digest of the empty text; texts are taken whole, whatever their length; rows that repeat get
equal results; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

import codecs
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import vocabulary_path
from .common import table

MODEL_FILE = "piece_bpe_32k.model"
#: Characters that new words of a batch have together before they are merged; words that a worker's table holds; characters from which words are cut and not held.
FLAT_CHARS, MEMO_WORDS, LONG = 1 << 18, 1 << 16, 48
#: Fixed values of the format: the mark of white space, what an unknown id gives, kinds of pieces.
SPACE_MARK, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.int64(1) << 62

codecs.register_error("quarrykit_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """The tables of a model file, encode() and decode()."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trained, rules = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if trained.model_type != trained.BPE or not trained.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is no byte-pair model with byte fallback and texts taken as they are")
        self.prefix = SPACE_MARK if rules.add_dummy_prefix else ""
        self.begin, self.end = trained.bos_id, trained.eos_id
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        score = {p: model.pieces[i].score for p, i in normal.items()}
        self.byte_ids = [0] * 256
        self.text_of = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            self.text_of.append({NORMAL: p.piece.replace(SPACE_MARK, " ").encode(), UNKNOWN: UNKNOWN_TEXT.encode(), CONTROL: b"", BYTE: bytes([int(p.piece[3:5], 16)] if p.type == BYTE else [])}[p.type])
        self.starts_word = {i for p, i in normal.items() if p.startswith(SPACE_MARK)}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        # symbols: pieces by id, then characters of pieces that are no pieces; others are told by code point
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(model.pieces) + len(symbol))
        self.symbol, self.width = symbol, 1 + max([0, *symbol.values()])
        self.char_of = {i: p for p, i in symbol.items() if i >= len(model.pieces)}
        self.n_pieces = len(model.pieces)
        self.repeated = self._repeated(score)
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, i in normal.items():
            for k in range(1, 0 if p in self.repeated else len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (order[score[p]], i)
        self.reach = 2 * max(map(len, normal), default=1)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.across = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        spaced = any(SPACE_MARK in x[1:] and x[0] != SPACE_MARK for x in self.across)
        self.find = (lambda t: [t] if t else []) if spaced else re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+").findall
        self.held: dict[str, bytes] = {}

    @staticmethod
    def _repeated(score: dict[str, float]) -> set[str]:
        """The pieces of the last score, if they all repeat one character and no other piece holds that character next to itself."""
        least = min(score.values(), default=0.0)
        last = {p for p in score if score[p] == least and len(p) > 1}
        c = next(iter(last))[0] if last else ""
        if any(p != c * len(p) for p in last) or any(c + c in p for p in score if p not in last):
            return set()
        return last

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        each, at = np.unique(code, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), self.width + c) for c in each.tolist()], np.int64)[at]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out: list[bytes] = [b""] * len(words)
        rank, made = self._ranked(sym, word)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            done = least == NONE
            if done.any():
                over = np.repeat(done, size)
                self._give(sym[over], word[over], out)
                sym, word, rank, made = (x[~over] for x in (sym, word, rank, made))
                least, size = least[~done], size[~done]
                if not len(sym):
                    break
            found = np.flatnonzero(rank == np.repeat(least, size))
            begins = np.r_[True, np.diff(found) != 1]
            found = found[(found - found[begins][np.cumsum(begins) - 1]) % 2 == 0]  # of places that overlap, every second one from the left
            group = np.r_[True, (word[found[1:]] != word[found[:-1]]) | (np.diff(found) > self.reach)]
            noisy = self._noisy(sym, word, rank, made, found)
            before = np.cumsum(noisy) - noisy
            take = found[before == before[group][np.cumsum(group) - 1]]
            sym[take] = made[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, made = (x[keep] for x in (sym, word, rank, made))
            now = place[take]
            near = np.unique(np.r_[now, now[now > 0] - 1])
            rank[near], made[near] = self._ranked_at(sym, word, near)
        return out

    def _noisy(self, sym, word, rank, made, found) -> np.ndarray:
        """Of places that merge from the left, those after which a pair arises that isn't of a worse rank."""
        left, right = np.maximum(found - 1, 0), np.minimum(found + 2, len(sym) - 1)
        joined = np.r_[False, np.diff(found) == 2]  # the symbol before is a merged one by then
        before = np.where(joined, made[np.maximum(found - 2, 0)], sym[left])
        a = self._looked(before, made[found], (found > 0) & (word[left] == word[found]))[0]
        b = self._looked(made[found], sym[right], (found + 2 < len(sym)) & (word[right] == word[found]))[0]
        return np.minimum(a, b) <= rank[found]

    def _ranked(self, sym: np.ndarray, word: np.ndarray):
        return self._ranked_at(sym, word, np.arange(len(sym)))

    def _ranked_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray):
        """The rank that the symbol at each place has with the next one (NONE where they don't merge), and what they give."""
        after = np.minimum(at + 1, len(sym) - 1)
        return self._looked(sym[at], sym[after], (at + 1 < len(sym)) & (word[after] == word[at]))

    def _looked(self, left: np.ndarray, right: np.ndarray, ok: np.ndarray):
        rank, made = np.full(len(ok), NONE), np.zeros(len(ok), np.int64)
        ok = np.flatnonzero(ok & (left < self.width) & (right < self.width))
        if len(self.keys) and len(ok):
            key = left[ok] * self.width + right[ok]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            rank[ok], made[ok] = np.where(hit, self.ranks[k], NONE), np.where(hit, self.made[k], 0)
        return rank, made

    def _give(self, sym: np.ndarray, word: np.ndarray, out: list[bytes]) -> None:
        if self.repeated:
            sym, word = self._runs(sym, word)
        odd = np.flatnonzero(sym >= self.n_pieces)
        if len(odd):  # characters that are no pieces: their bytes instead
            each, at = np.unique(sym[odd], return_inverse=True)
            ids = [[self.byte_ids[b] for b in (self.char_of[s] if s < self.width else chr(s - self.width)).encode()] for s in each.tolist()]
            length = np.array([len(x) for x in ids])
            times = np.ones(len(sym), np.int64)
            times[odd] = length[at]
            begin = (np.cumsum(times) - times)[odd]
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            flat, start = np.array([i for x in ids for i in x], np.int64), np.cumsum(length) - length
            for k in range(int(length.max())):
                own = length[at] > k
                sym[begin[own] + k] = flat[start[at[own]] + k]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        ids = sym.astype("<u4").tobytes()
        for w, a, b in zip(word[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sym)]):
            out[w] = ids[4 * a : 4 * b]

    def _runs(self, sym: np.ndarray, word: np.ndarray):
        """Runs of the character that has repeated pieces, put together from the left."""
        c = next(iter(self.repeated))[0]
        own = sym == self.symbol[c]
        begins = np.r_[True, ~own[1:] | ~own[:-1] | (word[1:] != word[:-1])]
        start = np.flatnonzero(begins)
        length = np.diff(np.r_[start, len(sym)])
        long = np.flatnonzero(length > 1)
        if not len(long):
            return sym, word
        keep = begins.copy()
        out = sym.copy()
        for n in np.unique(length[long]).tolist():
            sizes = np.array(self._put_together(n))
            at = (start[long[length[long] == n]][:, None] + np.cumsum(sizes) - sizes).ravel()
            keep[at] = True
            out[at] = np.tile([self.symbol[c * k] for k in sizes.tolist()], len(at) // len(sizes))
        return out[keep], word[keep]

    def _put_together(self, n: int) -> list[int]:
        """The lengths of the pieces of a run of n; all merges have one rank, so that the leftmost goes first each time."""
        sizes = {len(p) for p in self.repeated}
        done: list[int] = []
        left = n
        while left:
            now, left = 1, left - 1
            while True:
                if done and done[-1] + now in sizes:
                    now += done.pop()
                elif left and now + 1 in sizes:
                    now, left = now + 1, left - 1
                else:
                    break
            done.append(now)
        return done

    def words(self, text: str) -> list[str]:
        """The words of a text; none goes on where no piece goes across."""
        if not text:
            return []
        found = self.find(self.prefix + text.replace(" ", SPACE_MARK))
        if max(map(len, found)) <= LONG:
            return found
        out = []
        for w in found:
            if len(w) <= LONG:
                out.append(w)
                continue
            cuts = [0, *(k + 1 for k in range(len(w) - 1) if w[k : k + 2] not in self.across), len(w)]
            out += [w[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: list[str]):
        """The ids of each text, with begin and end, as bytes. Texts are taken together until their new words have FLAT_CHARS characters."""
        edge = [np.array([x], "<u4").tobytes() for x in (self.begin, self.end)]
        waiting: list[list[str]] = []
        new: dict[str, bytes] = {}
        chars = 0

        def settle():
            made = self.merged(list(new)) if new else []
            new.update(zip(list(new), made, strict=True))
            for words in waiting:
                yield b"".join([edge[0], *[new[w] if w in new else self.held[w] for w in words], edge[1]])
            self.held.update((w, ids) for w, ids in new.items() if len(w) <= LONG)
            if len(self.held) > MEMO_WORDS:
                self.held.clear()
            waiting.clear()
            new.clear()

        size = 0
        for text in texts:
            words = self.words(text)
            for w in words:
                if w not in self.held and w not in new:
                    new[w] = b""
                    chars += len(w)
            waiting.append(words)
            size += len(text)
            if chars > FLAT_CHARS or size > 8 * FLAT_CHARS:
                yield from settle()
                chars = size = 0
        yield from settle()

    def decode(self, ids: bytes) -> str:
        """The text of ids; control ids give nothing, an incomplete byte sequence one replacement character for each byte, a first mark of white space goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        out = b"".join(map(self.text_of.__getitem__, numbers)).decode("utf-8", "quarrykit_each_byte")
        if self.prefix and next((i for i in numbers if i not in self.silent), -1) in self.starts_word:
            return out[1:]
        return out


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, with the ids as little-endian bytes in ids if asked for; path is that of a .model file."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids)

    def run(batches):
        p = pieces(path)
        for batch in batches:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest(), *[ids] * keep_ids) for ids in p.encode(x.as_py() or "" for x in batch.column(1))]
            columns = [*zip(*rows, strict=True)] or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["doc_id", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), vocabulary_path(MODEL_FILE))
