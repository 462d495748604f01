"""SentencePiece BPE with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nptext

BLANK = "▁"
_NEVER = 1 << 30
#: Words remembered per worker; when full, the memory starts anew. With dropout, only those that stand so often in about 1,000 texts.
CACHE, OFTEN = 100_000, 4
#: Segmentations remembered per worker; when full, the memory starts anew.
SEGMENTED = 200_000


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece BPE model: rank of each (0 merges first), id, bytes, and which characters ever stand together."""

    ids: dict[str, int]
    rank: dict[str, int]
    byte_ids: list[int]
    pieces: list[bytes | None]
    words_split: bool
    split: re.Pattern
    symbol: np.ndarray = field(repr=False)  # symbol of each code point; the last one: none
    joins: np.ndarray = field(repr=False)  # left symbol * 2**32 + right symbol, ascending
    joined: np.ndarray = field(repr=False)  # what they become
    ranks: np.ndarray = field(repr=False)  # rank of that
    known: dict = field(default_factory=dict, repr=False)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a model file (one read per process)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids, pieces = {}, {}, [0] * 256, []
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(None)
        else:
            ids[piece] = i
            scores[piece] = sp.get_score(i)
            pieces.append(piece.replace(BLANK, " ").encode())
    order = sorted(scores, key=lambda p: -scores[p])
    joints = {p[i:i + 2] for p in ids for i in range(len(p) - 1)}
    words_split = not any(b == BLANK != a for a, b in joints)
    alone = [c for c in map(chr, range(128)) if not any(c in j for j in joints)]  # in no piece with others
    after_letter = {b for a, b in joints if a.isalpha()}
    marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after_letter and c not in alone]  # a cut before, after letters
    others = "".join({re.escape(a) for a, b in joints if re.fullmatch(r"[^\W\d_]", a) and not a.isalpha()})
    alone_, marks_ = ("".join(map(re.escape, x)) or BLANK for x in (alone, marks))
    split = re.compile(f"[{alone_}]|{BLANK}*[^{BLANK}{alone_}](?:[^{BLANK}{alone_}{marks_}]+|(?<![^\\W\\d_{others}])[{marks_}])*|{BLANK}+")
    rank = {p: r for r, p in enumerate(order)}
    number = dict(ids)
    for c in {c for p in ids for c in p}:
        number.setdefault(c, len(pieces) + len(number))
    symbol = np.full(0x110001, max(number.values(), default=0) + 1, np.int64)
    for c, i in number.items():
        if len(c) == 1:
            symbol[ord(c)] = i
    symbol[[ord(c) for c in number if len(c) == 1 and c not in ids]] = symbol[-1]  # without an own piece: by bytes
    pairs = sorted((number[p[:i]] << 32 | number[p[i:]], ids[p], rank[p]) for p in ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
    joins, joined, ranks = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([0], [0], [_NEVER])))
    return Vocabulary(ids, rank, byte_ids, pieces, words_split, split, symbol, joins, joined, ranks)


#: Multipliers of the keyed hash, by place in the unit.
_MULT = [int(x) | 1 for x in np.random.default_rng(7).integers(1, 1 << 62, 1 << 12)]
_MASK = (1 << 64) - 1
_MULTS = np.array(_MULT, np.uint64)
#: Longest unit that is merged side by side with others.
SHORT = 32


def _keys(seeds: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of occurrences: of the seed of their text and their place in it."""
    return nptext.mix(seeds + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _merge(unit: str, v: Vocabulary, limit: int, key: int) -> list[int]:
    """Ids of one unit: candidate merges are processed best rank first, leftmost on ties. A candidate is skipped for good if
    the hash of ``key`` (of this occurrence) and of its two ends is below ``limit``."""
    n = len(unit)
    rank = v.rank
    seed = int(nptext.mix(np.array([key], np.uint64))[0]) | 1 if limit else 0

    def skipped(i: int, stop: int) -> bool:
        return ((seed * (_MULT[i & 4095] + _MULT[stop & 4095 ^ 2048]) & _MASK) >> 32) < limit

    if n <= SHORT:  # a short agenda is a plain list with one place per border
        ends = list(range(1, n + 1))
        agenda = [rank.get(unit[i:i + 2], _NEVER) for i in range(n - 1)]
        if limit:
            for i in range(n - 1):
                if agenda[i] != _NEVER and skipped(i, i + 2):
                    agenda[i] = _NEVER
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            j = agenda.index(best)
            del ends[j], agenda[j]
            i = ends[j - 1] if j else 0
            stop = ends[j]
            if j < len(agenda):
                r = rank.get(unit[i:ends[j + 1]], _NEVER)
                agenda[j] = _NEVER if r != _NEVER and limit and skipped(i, ends[j + 1]) else r
            if j:
                left = ends[j - 2] if j > 1 else 0
                r = rank.get(unit[left:stop], _NEVER)
                agenda[j - 1] = _NEVER if r != _NEVER and limit and skipped(left, stop) else r
    else:
        ends = _long(unit, rank, limit, skipped)
    out, i = [], 0
    for e in ends:
        got = v.ids.get(unit[i:e])
        if got is not None:
            out.append(got)
        else:
            out += [v.byte_ids[b] for b in _raw(unit[i:e])]
        i = e
    return out


def _long(unit: str, rank: dict[str, int], limit: int, skipped) -> list[int]:
    """The same agenda as a heap, for units of any length: ends of the final symbols."""
    n = len(unit)
    end = list(range(1, n + 1))  # of the symbol that starts here; 0: merged away
    before = list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def put(i: int, mid: int, stop: int) -> None:
        r = rank.get(unit[i:stop])
        if r is not None and not (limit and skipped(i, stop)):
            heapq.heappush(agenda, (r, i, mid, stop))

    for i in range(n - 1):
        put(i, i + 1, i + 2)
    while agenda:
        _, i, mid, stop = heapq.heappop(agenda)
        if end[i] != mid or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            put(i, stop, end[stop])
        if before[i] >= 0:
            put(before[i], i, stop)
    out, i = [], 0
    while i < n:
        i = end[i]
        out.append(i)
    return out


def _merge_many(units: list[str], v: Vocabulary, limit: int, key: int | np.ndarray) -> list[list[int]]:
    """``_merge`` of many units (``key``: of each, or of all), side by side: each step takes the best candidate of every unit's agenda."""
    out: list[list[int]] = [[]] * len(units)
    size = np.array([len(u) for u in units], np.int64)
    key = np.broadcast_to(np.asarray(key, np.uint64), size.shape)
    order = np.argsort(size, kind="stable")
    order = order[np.searchsorted(size[order], 1):np.searchsorted(size[order], SHORT, side="right")]
    for i in np.flatnonzero(size > SHORT):
        out[i] = _merge(units[i], v, limit, int(key[i]))
    for part in np.array_split(order, max(1, order.size // 1500)):
        if part.size:
            _merge_part(part, units, size, v, limit, key, out)
    return out


def _merge_part(part: np.ndarray, units: list[str], size: np.ndarray, v: Vocabulary, limit: int, key: np.ndarray, out: list[list[int]]) -> None:
    n, width = part.size, int(size[part].max()) + 1
    own = size[part]
    code = np.frombuffer("".join([units[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
    grid = np.full((n, width), v.symbol[-1], np.int64)
    column = np.arange(width)
    grid[column < own[:, None]] = v.symbol[code]
    seed = nptext.mix(key[part]) | np.uint64(1) if limit else None
    after = np.minimum(column + 1, own[:, None])  # the next symbol's place; the unit's size at its end
    before = np.tile(column - 1, (n, 1))
    rank = np.full((n, width), _NEVER, np.int64)
    become = np.zeros((n, width), np.int64)

    def look(row, at):
        """Candidate of the symbol at a place and the next one."""
        right = after[row, at]
        pair = grid[row, at] << 32 | grid[row, right]
        slot = np.minimum(np.searchsorted(v.joins, pair), v.joins.size - 1)
        good = (v.joins[slot] == pair) & (right < own[row])
        if limit:
            stop = after[row, np.minimum(right, width - 1)]
            good &= (seed[row] * (_MULTS[at] + _MULTS[stop ^ 2048]) >> np.uint64(32)) >= np.uint64(limit)
        rank[row, at] = np.where(good, v.ranks[slot], _NEVER)
        become[row, at] = v.joined[slot]

    row, at = np.nonzero(column < own[:, None] - 1)
    look(row, at)
    alive = column < own[:, None]
    live = np.arange(n)
    while live.size:
        best = rank[live].argmin(axis=1)
        some = rank[live, best] < _NEVER
        live, best = live[some], best[some]
        if not live.size:
            break
        gone = after[live, best]
        grid[live, best] = become[live, best]
        alive[live, gone] = False
        rank[live, gone] = _NEVER
        then = after[live, gone]
        after[live, best] = then
        before[live, then] = best
        look(live, best)
        prior = before[live, best]
        has = prior >= 0
        look(live[has], prior[has])
    flat = grid[alive]
    stop = np.cumsum(alive.sum(axis=1))
    plain = ~((grid == v.symbol[-1]) & alive).any(axis=1)
    ids = flat.tolist()
    for k, (i, e) in enumerate(zip(part.tolist(), stop.tolist())):
        out[i] = ids[stop[k - 1] if k else 0:e] if plain[k] else _merge(units[i], v, limit, int(key[i]))


def _raw(piece: str) -> bytes:
    """Bytes of characters that have no piece; BLANK stands for a blank."""
    return piece.replace(BLANK, " ").encode("utf-8", "surrogatepass")


class _Known(dict):
    """Ids of the strings seen so far without dropout, made by ``make`` at first sight."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> list[int]:
        got = self.make(word)
        if len(word) < 64:
            self.trim()
            self[word] = got
        return got

    def trim(self) -> None:
        if len(self) >= CACHE:
            self.clear()


def _known(v: Vocabulary) -> _Known:
    known = v.known.get("plain")
    if known is None:
        known = v.known["plain"] = _Known(lambda w: _merge(w, v, 0, 0) if w else _literal(v))
    return known


def _literal(v: Vocabulary) -> list[int]:
    return [v.byte_ids[b] for b in BLANK.encode()]


#: Candidates of a remembered word, at most; they are the low bits of a segmentation's number.
WIDE = 46


def _candidates(unit: str, rank: dict[str, int]) -> tuple[list[tuple[int, int]], int]:
    """What dropout cannot change about a word: all candidate merges (start, stop) that any segmentation can come to, and as bits
    those that the segmentation without dropout comes to."""
    n = len(unit)
    stops = [1 << i + 1 for i in range(n)]  # bits of where symbols that start here may stop
    starts = [0] + [1 << i for i in range(n)]
    spans = {}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            stop = i + size
            if stops[i] & starts[stop] and unit[i:stop] in rank:
                spans[i, stop] = len(spans)
                stops[i] |= 1 << stop
                starts[stop] |= 1 << i
    ends, seen = list(range(1, n + 1)), 0
    agenda = [rank.get(unit[i:i + 2], _NEVER) for i in range(n - 1)]
    for i, r in enumerate(agenda):
        if r != _NEVER:
            seen |= 1 << spans[i, i + 2]
    while agenda:
        best = min(agenda)
        if best == _NEVER:
            break
        j = agenda.index(best)
        del ends[j], agenda[j]
        for k in (j, j - 1):
            if 0 <= k < len(agenda):
                i, stop = ends[k - 1] if k else 0, ends[k + 1]
                agenda[k] = rank.get(unit[i:stop], _NEVER)
                if agenda[k] != _NEVER:
                    seen |= 1 << spans[i, stop]
    return list(spans), seen


class _Words:
    """Candidate merges of the words seen so far, and segmentations by word and skipped candidates. Which are skipped is drawn for each
    occurrence; what is remembered follows from the word and that draw alone."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.first = self.count = self.path = np.zeros(0, np.int64)
        self.mult = np.zeros(0, np.uint64)
        self.ids: dict[int, bytes] = {}

    def learn(self, words: list[str], rank: dict[str, int]) -> None:
        """Words that are longer or have more candidates than can be numbered stay out."""
        count, path, mult = [], [], []
        for w in words:
            spans, seen = _candidates(w, rank)
            if len(spans) <= WIDE:
                self.number[w] = len(self.number)
                count.append(len(spans))
                path.append(seen)
                mult += [_MULT[i] + _MULT[stop ^ 2048] & _MASK for i, stop in spans]
        count = np.array(count, np.int64)
        self.first = np.concatenate([self.first, self.mult.size + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.path = np.concatenate([self.path, np.array(path, np.int64)])
        self.mult = np.concatenate([self.mult, np.array(mult, np.uint64)])

    def draw(self, number: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
        """Word and skipped candidates of occurrences as one number; none are skipped if the segmentation without dropout meets none of them."""
        out = np.empty(number.size, np.int64)
        for a in range(0, number.size, 1 << 16):
            word = number[a:a + (1 << 16)]
            seed = nptext.mix(key[a:a + (1 << 16)]) | np.uint64(1)
            n = self.count[word]
            row = np.repeat(np.arange(word.size), n)
            bit = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero((seed[row] * self.mult[self.first[word][row] + bit] >> np.uint64(32)) < np.uint64(limit))
            skipped = np.bincount(row[hit], np.ldexp(1.0, bit[hit]), word.size).astype(np.int64)  # exact: below 2**53
            out[a:a + (1 << 16)] = word << WIDE | np.where(skipped & self.path[word], skipped, 0)
        return out


def _units(text: str, v: Vocabulary, dummy_prefix: bool = False) -> list[str]:
    """What merges by itself: words, or the whole text; an empty one is a literal U+2581."""
    if BLANK in text:
        parts = text.split(BLANK)
        out = _units(parts[0], v, dummy_prefix)
        for part in parts[1:]:
            out += ["", *_units(part, v)]
        return out
    if not text:
        return []
    text = (BLANK if dummy_prefix else "") + text.replace(" ", BLANK)
    return v.split.findall(text) if v.words_split else [text]


def _vary(cut: list[list[str]], v: Vocabulary, limit: int, seeds: list[int]) -> list[np.ndarray]:
    """Ids of texts that are cut into units: each occurrence of a unit skips merges by its own key."""
    words = v.known.get("words")
    if words is None:
        words = v.known["words"] = _Words()
    if len(words.number) >= CACHE:
        words.clear()
    if len(words.ids) >= SEGMENTED:
        words.ids.clear()
    flat = list(chain.from_iterable(cut))
    size = np.array([len(c) for c in cut], np.int64)
    begin = np.cumsum(size) - size
    key = _keys(np.repeat(np.array([s & _MASK for s in seeds], np.uint64), size), np.arange(len(flat)) - np.repeat(begin, size))
    often = [w for w, n in Counter(flat).items() if n >= OFTEN and w not in words.number and 0 < len(w) <= SHORT]
    words.learn(often[:max(0, CACHE - len(words.number))], v.rank)
    number = np.array(list(map(words.number.get, flat, repeat(-1))), np.int64)

    at = np.flatnonzero(number >= 0)
    drawn, first, place, held = np.unique(words.draw(number[at], key[at], limit), return_index=True, return_inverse=True, return_counts=True)
    ids = list(map(words.ids.get, drawn.tolist()))
    new = [k for k, got in enumerate(ids) if got is None]
    alone = np.flatnonzero(number < 0)  # merged by themselves, and not remembered
    todo = np.concatenate([at[first[new]], alone])
    units = [flat[i] for i in todo.tolist()]
    got = [array("i", x).tobytes() for x in _merge_many(units, v, limit, key[todo])]
    for k, x, n in zip(new, got, held[new].tolist()):
        ids[k] = x
        if n > 1:
            words.ids[int(drawn[k])] = x
    own = got[len(new):]
    if "" in units:
        own = [x if u else array("i", _literal(v)).tobytes() for x, u in zip(own, units[len(new):])]
    slot = np.empty(len(flat), np.int64)
    slot[at], slot[alone] = place, drawn.size + np.arange(alone.size)
    out = list(map((ids + own).__getitem__, slot.tolist()))
    return [np.frombuffer(b"".join(out[a:a + n]), np.int32) for a, n in zip(begin.tolist(), size.tolist())]


def encode(text: str, v: Vocabulary, dropout: float = 0.0, seed: int = 0, dummy_prefix: bool = False) -> list[int]:
    """Ids of a text. Blanks become U+2581; a literal U+2581, and characters without a piece, become byte pieces.

    With ``dropout`` 0 it is the plain BPE segmentation. Otherwise each occurrence of a word draws anew, by ``seed`` and its place.
    """
    cut = _units(text, v, dummy_prefix)
    limit = int(dropout * (1 << 32))
    if limit:
        return _vary([cut], v, limit, [seed])[0].tolist()
    return list(chain.from_iterable(map(_known(v).__getitem__, cut)))


def encode_many(texts: list[str], v: Vocabulary, dropout: float = 0.0, seed: int | list[int] = 0) -> list[list[int]]:
    """``encode`` of many texts (``seed``: of each, or of all); words that are new are merged side by side."""
    return [x.tolist() for x in _encode_arrays(texts, v, dropout, [seed] * len(texts) if isinstance(seed, int) else seed)]


def _encode_arrays(texts: list[str], v: Vocabulary, dropout: float, seeds: list[int]) -> list[np.ndarray]:
    limit = int(dropout * (1 << 32))
    cut = [_units(t, v) for t in texts]
    if limit:
        return _vary(cut, v, limit, seeds)
    known = _known(v)
    known.trim()
    new = [w for w in set(chain.from_iterable(cut)) if w not in known and 0 < len(w) < 64]
    known.update(zip(new, _merge_many(new, v, 0, 0)))
    return [np.array(list(chain.from_iterable(map(known.__getitem__, words))), np.int32) for words in cut]


def decode(ids, v: Vocabulary) -> str:
    """The text of ids: pieces joined, byte pieces as bytes. Ids without text (control pieces) are an error."""
    return b"".join([v.pieces[i] for i in ids]).decode("utf-8", "surrogatepass")


def encode_table(df: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, doc_id: str = "doc_id",
                 text: str = "text", check: bool = True) -> DataFrame:
    """All rows and columns of ``df`` with ``ids``, ``n_tokens``, ``ids_crc32`` (of little-endian unsigned 32-bit ids) and
    ``decoded_sha256`` (of the UTF-8 text that decoding the ids gives).

    ``model``: path of the model file on the driver; its bytes go to the workers. Each occurrence of a word skips merges by a hash of
    ``seed``, the document's id (null: its text) and the word's place, so a rerun gives the same ids. A null or empty text has no
    ids. Existing columns of those names are replaced.
    """
    added = ["ids", "n_tokens", "ids_crc32", "decoded_sha256"]
    df = df.drop(*added)
    column, key = df.columns.index(text), df.columns.index(doc_id)
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        import hashlib

        v = load_bytes(shared.value)
        for batch in batches:
            keys, texts = batch.column(key).to_pylist(), batch.column(column).to_pylist()
            for i in range(0, len(texts), 1000):
                part = [t or "" for t in texts[i:i + 1000]]
                own = [xxhash.xxh64_intdigest((t if k is None else str(k)).encode("utf-8", "surrogatepass"), seed & _MASK) for k, t in zip(keys[i:i + 1000], part)]
                crc, sha = [], []
                ids = _encode_arrays(part, v, dropout, own)
                for got in ids:
                    crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                    sha.append(hashlib.sha256(decode(got.tolist(), v).encode("utf-8", "surrogatepass")).hexdigest() if check else None)
                n = np.array([x.size for x in ids], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                                                 pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                rows = batch.slice(i, len(n))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(sha, pa.string())],
                                                 names=[*batch.schema.names, *added])

    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
            T.StructField("decoded_sha256", T.StringType())]
    return df.mapInArrow(work, T.StructType([*df.schema.fields, *more]))


_LOADED: dict[int, Vocabulary] = {}


def load_bytes(model: bytes) -> Vocabulary:
    """A model from its bytes, once per process."""
    import os
    import tempfile

    key = zlib.crc32(model)
    if key not in _LOADED:
        with tempfile.NamedTemporaryFile(suffix=".model", delete=False) as f:
            f.write(model)
        _LOADED[key] = load(f.name)
        os.unlink(f.name)
    return _LOADED[key]


def decode_table(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns with the text of ``ids`` (null ids: null)."""
    df = df.drop(text)
    at = df.columns.index(ids)
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        v = load_bytes(shared.value)
        for batch in batches:
            got = [None if x is None else decode(x, v) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def model_path() -> str:
    """The installed 32k BPE model."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def same_text(df: DataFrame, text: str = "text"):
    """Column: decoding gave back the text (null: empty)."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256) == F.col("decoded_sha256")
