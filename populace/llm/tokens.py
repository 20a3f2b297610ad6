"""Encoding whole texts with the tokenizers library, one call for each distinct word.

Both vocabularies cut a text into pre-tokens before merging. A batch of texts is
first cut at places where a pre-token always ends; equal pieces of the batch are
numbered by Arrow, each distinct piece is looked up once, and the texts' ids are
gathered by number. Pieces of plain Latin letters, digits and ASCII symbols, whose
pre-tokens are known, go to the library's merge model directly; all other pieces
pass through its whole chain. Pieces are kept in a two-generation cache of bounded
size. Results equal those of encoding the text in one call, with the strings of special
tokens inside a text as plain text (``encode_special_tokens``), as the vocabularies' notes
say: a call that leaves that switch off gives other ids for a text that holds them.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces held in each generation of a worker's cache.
CACHE = 700_000

# Latin letters below U+0250, which no normal form changes and which lower-case one by one
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏ"
_SYMBOLS = r"!-&(-/:-@\[-`{-~"
PRE_TOKENS = {
    "word": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+"),
    "byte": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SYMBOLS}]+|\n(?=\S)"),
}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceEncoder:
    """ids of a text for a tokenizer file. mode "word": the file drops white
    space and case, so ASCII white space cuts. mode "byte": a space before a
    non-space starts a pre-token, so it cuts; texts with two adjacent spaces,
    where it may not, are encoded in one call."""

    def __init__(self, path: str, mode: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.mode, self.limit = mode, cache
        self.new: dict = {}
        self.old: dict = {}
        self.parts: dict[str, bytes] = {}
        self.model, self.letters, self.find = self.t.model, byte_letters(), PRE_TOKENS[mode].findall

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, remembered."""
        new, old, known, slow = self.new, self.old, self.parts, []
        word, find, tokenize, letters = self.mode == "word", self.find, self.model.tokenize, self.letters
        out = list(map(new.get, pieces))
        for n, ids in enumerate(out):
            if ids is not None:
                continue
            p = pieces[n]
            if (ids := old.get(p)) is None:
                text = p.lower() if word else p
                body = text[1:] if text[:1] == " " else text
                # plain letters are one pre-token; U+00AA, U+00B5 and U+00BA are letters that normal forms change
                if body.isalpha() and (body.isascii() or max(body) < "\u0250" and "\xaa" not in body and "\xb5" not in body and "\xba" not in body):
                    parts = (text,)
                else:
                    parts = find(text)
                    if "".join(parts) != text:
                        slow.append(n)  # its pre-tokens aren't known
                        continue
                ids = b""
                for q in parts:
                    if (i := known.get(q)) is None:
                        shown = q if q.isascii() and q[0] not in " \n" else q.encode().decode("latin-1").translate(letters)
                        known[q] = i = array("I", [x.id for x in tokenize(shown)]).tobytes()
                    ids += i
            new[p] = out[n] = ids
        if len(known) > 2 * self.limit:
            known.clear()
        if slow:
            for n, e in zip(slow, self.t.encode_batch_fast([pieces[n] for n in slow], add_special_tokens=False)):
                new[pieces[n]] = out[n] = array("I", e.ids).tobytes()
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return out

    def encode_many(self, texts: list[str | None] | pa.Array, spaced: bool = False) -> list[np.ndarray]:
        """uint32 ids of each text; a null text is empty. spaced (mode "byte"): of a space and the text."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(col):
            return []
        col, whole = pc.fill_null(col, ""), np.empty(0, np.int64)
        if self.mode == "word":
            cut = pc.ascii_split_whitespace(col)
        else:
            odd = pc.or_(pc.match_substring(col, "  "), pc.starts_with(col, " "))
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            cut = pc.split_pattern(pc.if_else(odd, "", col), " ")
        ends = cut.offsets.to_numpy()
        named = cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        code, ends = named.indices.to_numpy().astype(np.int64), ends - ends[0]
        words = named.dictionary.to_pylist()
        if self.mode == "byte":  # all but a text's first piece follow a space
            firsts = np.empty(0, np.int64) if spaced else ends[:-1][ends[1:] > ends[:-1]]
            later = np.ones(code.size, bool)
            later[firsts] = False
            used = np.flatnonzero(np.bincount(code[later], minlength=len(words)))
            bare, at = np.unique(code[firsts], return_inverse=True)
            place = np.zeros(len(words), np.int64)
            place[used] = np.arange(used.size)
            code = place[code]
            code[firsts] = used.size + at
            words = [" " + words[i] for i in used.tolist()] + [words[i] for i in bare.tolist()]
        held = self._ids(words)
        size = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        pool, begin = np.frombuffer(b"".join(held), np.uint32), np.cumsum(size) - size
        n = size[code]
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(begin[code] - stop[:-1], n) + np.arange(stop[-1])]
        edge = stop[ends]
        out = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        if whole.size:
            for i, e in zip(whole.tolist(), self.t.encode_batch_fast([" " * spaced + col[i].as_py() for i in whole.tolist()], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


_made: dict = {}


def encoder(path: str, mode: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    key = path, mode
    if key not in _made:
        _made[key] = PieceEncoder(path, mode)
    return _made[key]
