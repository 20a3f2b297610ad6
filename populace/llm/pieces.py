"""SentencePiece encoding that keeps, for every piece, the bytes of the text it stands for.

A text is normalised first: at each place the longest entry of the model's compiled
character map (a double-array trie) is replaced, and every byte written remembers where
in the text its entry began. Merges then run over the normalised text, piece by piece from
the best score on, and a piece's ends are looked up in that record. Texts without an entry
of the map take the same steps over whole arrays.

Merges can't pass a pair of characters that no piece holds side by side, so a text is cut
there, before spaces and between letters and other characters; equal parts are merged once
for each worker (a two-generation cache of bounded size).

Nulls: a null text is an empty one, of no pieces but the end id; a null doc_id stays. Texts
are encoded whole, repeated rows each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Parts in each generation of a worker's cache, and their largest size in characters.
CACHE, CACHED_CHARS = 400_000, 48
#: Characters up to which a part's pairs are looked through for each merge.
SHORT = 24
_NONE = float("inf")
SPACE = "▁"
#: Runs in which a word is looked up: letters and digits after spaces, or neither.
RUNS = re.compile(rf"{SPACE}*[^\W_]+|(?:[^\w{SPACE}]|_)+|{SPACE}+").findall
_MARK = SPACE.encode()
#: Types of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """A compiled character map: the size of the trie, its 32-bit units, then the
    replacements, each ended by a zero byte (fixed format)."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :]
        # pairs of bytes at which an entry may begin: it ends after the first or goes on past it
        self.opens = np.zeros((256, 257), bool)
        for a in range(256) if self.units else ():
            node, leaf = self._step(self._offset(self.units[0]), a)
            if node is None:
                continue
            self.opens[a] = leaf is not None
            for b in range(256):
                self.opens[a, b] |= self._step(node, b)[0] is not None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> tuple[int | None, int | None]:
        """The node below and, if an entry ends there, the place of its replacement."""
        at = node ^ byte
        unit = self.units[at]
        if unit & 0x800000FF != byte:
            return None, None
        below = at ^ self._offset(unit)
        return below, self.units[below] & 0x7FFFFFFF if unit & 256 else None

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that begins at byte i."""
        node, best, start = self._offset(self.units[0]), None, i
        while i < len(data):
            node, value = self._step(node, data[i])
            if node is None:
                break
            i += 1
            if value is not None:
                best = i - start, value
        if best is None:
            return None
        return best[0], self.values[best[1] : self.values.index(b"\0", best[1])]


class SentencePieces:
    """The merges of a BPE model file, and decoding."""

    def __init__(self, path: str, cache: int = CACHE):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE:
            raise ValueError("not a BPE model")
        if model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("a model that changes decoded texts is not supported")
        self.prefix, self.strip, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, trained.treat_whitespace_as_suffix
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.byte_fallback, self.unk_surface = trained.byte_fallback, trained.unk_surface
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.unk = self.kinds.index(UNKNOWN)
        self.end = self.names.index(trained.eos_piece or "</s>")
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.names, self.kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.score = {p: -model.pieces[i].score for p, i in self.id_of.items()}
        self.unused = {p for p, i in self.id_of.items() if self.kinds[i] == UNUSED}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.names, self.kinds)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        users = sorted((p for p, i in self.id_of.items() if self.kinds[i] == USER_DEFINED), key=len, reverse=True)
        self.users = re.compile("|".join(map(re.escape, users))) if users else None
        self.user_bytes = re.compile(b"|".join(re.escape(p.encode()) for p in users)) if users else None
        self.user_first = np.zeros(256, bool)
        self.user_first[[p.encode()[0] for p in users]] = True
        self.pairs = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        # no piece goes on past the end of a word: texts are cut before each space
        self.words = None if users or any(p.endswith(SPACE) and p.strip(SPACE) or SPACE in p.lstrip(SPACE) for p in self.id_of) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: What a piece stands for in a decoded text.
        self.bytes_of = [bytes([self.byte_of[i]]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.names, self.kinds))]
        #: Bytes of normalised text under a piece.
        self.width = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.names, self.kinds)], np.int64)
        self.limit, self.new, self.old = cache, {}, {}

    # -- normalisation ---------------------------------------------------------------

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """``data`` with the longest entries replaced, and for every byte written (and
        the end) where in ``data`` its character or entry begins."""
        raw = np.frombuffer(data, np.uint8)
        at = np.arange(raw.size + 1)
        inner = np.zeros(raw.size + 1, bool)
        inner[:-1] = (raw & 0xC0) == 0x80
        at = np.maximum.accumulate(np.where(inner, 0, at))
        begins = self.user_first[raw]
        if self.map:
            begins |= self.map.opens[raw, np.append(raw[1:], 256)[: raw.size]]
        spots = np.flatnonzero(begins & ~inner[:-1])
        out, src, done = [], [], 0
        for i in spots.tolist():
            if i < done:
                continue
            if self.user_bytes and (m := self.user_bytes.match(data, i)):
                found = len(m[0]), m[0]
            elif not self.map or (found := self.map.longest(data, i)) is None:
                continue
            out += [data[done:i], found[1]]
            src += [at[done:i], np.full(len(found[1]), i)]
            done = i + found[0]
        if not done:
            return data, at
        return b"".join([*out, data[done:]]), np.concatenate([*src, at[done:]])

    def _stripped(self, data: bytes, src: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Without spaces at the ends and repeated spaces between units (a unit is what one
        character or entry became; spaces inside a unit stay)."""
        if not (data.startswith(b" ") or data.endswith(b" ") or b"  " in data):
            return data, src
        cuts = [0, *(np.flatnonzero(np.diff(src[:-1])) + 1).tolist(), len(data)]
        keep, spaced = np.ones(src.size, bool), True
        for a, b in zip(cuts, cuts[1:]):
            i = a
            while spaced and i < b and data[i] == 32:
                keep[i] = False
                i += 1
            if i < b:
                spaced = data[b - 1] == 32
        end = len(data)
        while end and (data[end - 1] == 32 or not keep[end - 1]):
            if keep[end - 1]:
                src = np.append(src[:-1], src[end - 1])
            end -= 1
            keep[end] = False
        return bytes(np.frombuffer(data, np.uint8)[keep[:-1]]), src[keep]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text that pieces are made of, and for each of its bytes (and its end) the
        byte of ``text`` where what it came from begins."""
        data, src = self._mapped(text.encode())
        first = 0
        if self.strip:
            data, src = self._stripped(data, src)
            first = int(src[0])
        if not data:
            return b"", src[-1:]
        if self.prefix and not self.suffix:
            data, src = b" " + data, np.concatenate([[first], src])
        elif self.prefix:
            data, src = data + b" ", np.append(src, src[-1])
        if self.escape:
            wide = np.ones(src.size, np.int64)
            wide[:-1][np.frombuffer(data, np.uint8) == 32] = len(_MARK)
            if not self.prefix or self.suffix or wide.sum() > src.size + 2:
                src = np.repeat(src, wide)
            else:  # the one space is the prefix
                src = np.concatenate([[first, first], src])
            data = data.replace(b" ", _MARK)
        return data, src

    # -- merges ----------------------------------------------------------------------

    def _merge(self, part: str) -> list[str]:
        """The symbols that are left when no two neighbours make a piece: the best score
        first, of equal ones the leftmost."""
        if self.users or self.unused or len(part) > SHORT:
            return self._merge_queued(part)
        get, sym = self.score.get, list(part)
        scores = [get(a + b, _NONE) for a, b in zip(sym, part[1:])]
        last = len(scores) - 1
        while last >= 0 and (best := min(scores)) != _NONE:
            i = scores.index(best)
            sym[i] = both = sym[i] + sym.pop(i + 1)
            del scores[i]
            last -= 1
            if i <= last:
                scores[i] = get(both + sym[i + 1], _NONE)
            if i:
                scores[i - 1] = get(sym[i - 1] + both, _NONE)
        return sym

    def _merge_queued(self, part: str) -> list[str]:
        """The same for long parts (a queue of pairs, stale ones skipped), and for models
        with pieces that users defined, which no merge enters, or that are out of use."""
        if self.users:
            sym, fixed, i = [], set(), 0
            while i < len(part):
                m = self.users.match(part, i)
                if m:
                    fixed.add(len(sym))
                sym.append(m[0] if m else part[i])
                i += len(sym[-1])
        else:
            sym, fixed = list(part), ()
        n, score, made = len(sym), self.score, {}
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (s := score.get(sym[i] + sym[i + 1])) is not None and i not in fixed and i + 1 not in fixed:
                heap.append((s, i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapify(heap)
        while heap:
            _, i, j, size = heappop(heap)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size:
                continue
            both = sym[i] + sym[j]
            if both in self.unused:
                made[both] = sym[i], sym[j]
            sym[i], sym[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if k not in fixed and (s := score.get(both + sym[k])) is not None:
                    heappush(heap, (s, i, k, size + len(sym[k])))
            h = before[i]
            if h >= 0 and h not in fixed and (s := score.get(sym[h] + both)) is not None:
                heappush(heap, (s, h, i, len(sym[h]) + size))
        left = [s for s in sym if s]
        while any(s in made for s in left):  # a piece out of use is taken apart again
            left = [t for s in left for t in made.get(s, (s,))]
        return left

    def _word_ids(self, key: str) -> bytes:
        """ids of the word that a key of the cache names (see words_of); of an unknown piece its
        bytes, negative, where the model has no pieces for single bytes."""
        word = key[1:] if SPACE in key else SPACE + key
        if self.users or key.isalpha():
            return self._part_ids(word)
        pairs, new, old, parts = self.pairs, self.new, self.old, []
        for run in RUNS(word):  # letters and others, but together where a piece holds both
            if parts and parts[-1][-1] + run[0] in pairs:
                parts[-1] += run
            else:
                parts.append(run)
        if len(parts) == 1:
            return self._part_ids(word)
        ids = b""
        for part in parts:
            p = self._key(part)
            if (got := new.get(p) or old.get(p)) is None:
                got = self._part_ids(part)
                if len(part) <= CACHED_CHARS:
                    new[p] = got
            ids += got
        return ids

    @staticmethod
    def _key(word: str) -> str:
        """A word after one space by its letters alone; all others by a space and themselves."""
        return word[1:] if word[:1] == SPACE and word[1:2] not in ("", SPACE) else SPACE + word

    def words_of(self, shown: str) -> list[str]:
        """The keys of a normalised text's words."""
        if not self.words:
            return [SPACE + shown] if shown else []
        if shown[:1] == SPACE and shown[-1] != SPACE and SPACE + SPACE not in shown:
            return shown[1:].split(SPACE)
        return list(map(self._key, self.words.findall(shown)))

    def _part_ids(self, part: str) -> bytes:
        left = self._merge(part)
        got = array("i", map(self.id_of.get, left, repeat(-1)))
        if -1 in got:
            got = array("i")
            for s in left:
                raw = s.encode()
                if (i := self.id_of.get(s)) is not None:
                    got.append(i)
                elif self.byte_fallback:
                    got.extend(map(self.byte_ids.__getitem__, raw))
                else:
                    got.append(-len(raw))
        return got.tobytes()

    def _ids(self, shown: str) -> np.ndarray:
        words = self.words_of(shown)
        new, long = self.new, {}
        for w in set(words).difference(new):
            got = self.old.get(w) or self._word_ids(w)
            (new if len(w) <= CACHED_CHARS else long)[w] = got
        held = [new.get(w) or long[w] for w in words] if long else list(map(new.__getitem__, words))
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return np.frombuffer(b"".join(held), np.int32)

    def ids(self, text: str | None) -> np.ndarray:
        """ids alone, of a model without a map that writes spaces as they come."""
        text = text or ""
        if self.map or self.strip or self.users or self.suffix or not (self.prefix and self.escape and self.byte_fallback):
            return self.encode(text)[0]
        return self._ids(SPACE + text.replace(" ", SPACE)) if text else np.empty(0, np.int32)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of a text, and the first byte and the byte past the last of each piece."""
        norm, src = self.normalise(text or "")
        ids = self._ids(norm.decode())
        widths = self.width[ids]
        if not self.byte_fallback and ids.size:  # neighbours that are unknown are one piece
            widths = np.where(ids < 0, -ids, widths)
            ids = np.maximum(ids, -1)
            first = np.append(True, (ids[1:] >= 0) | (ids[:-1] >= 0))
            widths = np.add.reduceat(widths, np.flatnonzero(first))
            ids = np.where(ids < 0, self.unk, ids)[first]
        stop = np.cumsum(widths)
        return ids, src[stop - widths], src[stop]

    # -- decoding --------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids: a first space goes that the prefix or stripping stands for; bytes
        that aren't UTF-8 become U+FFFD one by one."""
        out = list(map(self.bytes_of.__getitem__, ids))
        if self.unk in ids:
            out = [self.unk_surface.encode() if i == self.unk else b for i, b in zip(ids, out)]
        parted = b"" in out[:-1]  # control ids part runs of bytes
        if self.prefix or self.strip:
            for k, i in enumerate(ids):
                if self.kinds[i] == CONTROL:
                    continue
                name = self.names[i]
                if self.kinds[i] in (NORMAL, USER_DEFINED, UNUSED) and name.startswith(SPACE):
                    out[k] = out[k][1:]
                    if self.strip and not out[k]:
                        continue
                break
        try:
            return "".join(self._runs(ids, out)) if parted else b"".join(out).decode()
        except UnicodeDecodeError:
            return "".join(self._runs(ids, out))

    def _runs(self, ids: list[int], out: list[bytes]) -> Iterator[str]:
        run = b""
        for i, b in zip([*ids, self.end], [*out, b""]):
            if i in self.byte_of:
                run += b
                continue
            while run:
                n = next((k for k in range(1, 5) if _is_char(run[:k])), 0)
                yield run[:n].decode() if n else "�"
                run = run[n or 1 :]
            yield b.decode()


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_made: dict = {}


def encoder(path: str) -> SentencePieces:
    """One encoder for each worker process and file."""
    if path not in _made:
        _made[path] = SentencePieces(path)
    return _made[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_pieces: bool = False) -> DataFrame:
    """doc_id, n_tokens (the end id counts), ids_sha256, decoded_sha256 and spans_crc32: of the
    first and past-the-last byte of every piece as little-endian unsigned 32-bit integers; the
    end id spans nothing at the text's end. with_pieces: the ids and both offsets too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        digits = list(map(str, range(len(enc.names))))
        for b in batches:
            rows, kept = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                ids, begin, stop = enc.encode(t)
                n = len(t.encode())
                ids, spans = [*ids.tolist(), enc.end], np.append(np.column_stack([begin, stop]).ravel(), [n, n]).astype("<u4")
                rows.append((len(ids), hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest(), zlib.crc32(spans)))
                if with_pieces:
                    kept.append((ids, spans[::2].tolist(), spans[1::2].tolist()))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
            if with_pieces:
                cols += [pa.array([r[k] for r in kept], pa.list_(pa.int32())) for k in range(3)]
                names += ["ids", "begins", "ends"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long" + ", ids array<int>, begins array<int>, ends array<int>" * with_pieces
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)
