"""Token ids and token counts of whole texts, word by word with a memo.

Both tokenizers split at white space before they merge, so the ids of a text are the ids of its words
in order. A word is encoded once and remembered; the memo is dropped when it has grown to its bound.
Results equal those of the library on the whole text (tests/llm/test_operators.py).
"""

from __future__ import annotations

import re
from array import array
from sys import byteorder

#: Words a memo may hold before it is emptied.
MEMO_WORDS = 500_000
#: Longer words are encoded each time.
MEMO_BYTES = 64


class WordIds:
    """Ids of a `tokenizers` file whose pre-tokenizer drops white space; little-endian unsigned 32-bit."""

    kind = "<u4"
    _code = "I"
    _marks = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
    _latin = re.compile(r"[a-zß-öø-ÿ!-&(-/:-@\[-`{-~]+")
    _runs = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        normal, special = self.tokenizer.normalizer, self.tokenizer.get_added_tokens_decoder().values()
        self.folds = normal is not None and normal.normalize_str("AZ") == "az" and all("<" in t.content for t in special)
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {}
        # byte-level models write each byte as a printable character: itself, or the next one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in shown)
        self.byte_char = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}

    def _run(self, run: bytes) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            shown = run.decode() if run.isascii() else "".join(map(self.byte_char.__getitem__, run))
            made = array(self._code, [t.id for t in self.model.tokenize(shown)])
            if byteorder == "big":
                made.byteswap()
            ids = self.runs[run] = made.tobytes()
        return ids

    def _learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Latin letters and punctuation go to the model run by run; the rest through the whole tokenizer.

        Most words are letters of ASCII, or those and one mark: they need no look at their characters.
        """
        found, rest, run, marks = {}, [], self._run, self._marks
        for word in missing:
            if word.isalpha():
                found[word] = run(word.lower())
                continue
            if word[-1] in marks and word[:-1].isalpha():
                found[word] = run(word[:-1].lower()) + run(word[-1:])
                continue
            text = word.decode("utf-8", "replace")
            low = text.lower()
            if "<|" not in text and self._latin.fullmatch(low):
                found[word] = b"".join([run(part.encode()) for part in self._runs.findall(low)])
            else:
                rest.append(word)
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        for word, e in zip(rest, encoded, strict=True):
            found[word] = self.np.array(e.ids, self.kind).tobytes()
        return found

    def _folded(self, text: bytes) -> bytes:
        """A-Z lower-cased ahead of the normalizer that does so, where no special string and no combining mark needs them as they are."""
        return text.lower() if self.folds and b"<" not in text and b"\xcc" not in text else text

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        split = [self._folded(t or b"").replace(b"\n", b" ").split(b" ") for t in texts]
        if len(self.runs) > MEMO_WORDS:
            self.runs = {}
        if len(self.words) > MEMO_WORDS:  # runs outlast words: most are parts of several
            self.words = {}
        words = self.words
        words[b""] = b""
        found = self._learn(set().union(*split) - words.keys())
        words.update(found)
        out = [b"".join(map(words.__getitem__, units)) for units in split]
        for word in found:
            if len(word) > MEMO_BYTES:
                del words[word]
        return out


class NarrowIds(WordIds):
    """The same as unsigned 16-bit, for vocabularies whose ids fit."""

    kind = "<u2"
    _code = "H"


class PieceCounts:
    """Token counts of a `sentencepiece` model of the kind that marks spaces and never merges across a word's end."""

    _end = re.compile(rb"(?<=[^ ]) ")

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        #: a split before a space is safe when no piece goes on with a space after another character
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces)
        self.words: dict[bytes, int] = {}

    def _units(self, text: bytes) -> tuple[list[bytes], int]:
        """The parts to encode on their own, and the tokens of a lone space mark at the end."""
        if not self.safe:
            return [text], 0
        text = text.replace("▁".encode(), b" ")
        if b"  " in text or text[:1] == b" ":
            units = self._end.split(text)
        else:
            units = text.split(b" ")
        if len(units) > 1 and not units[-1]:
            return units[:-1], 1
        return units, 0

    def __call__(self, texts: list[bytes | None], batch_bytes: int = 1 << 20) -> list[int]:
        split = [self._units(t or b"") for t in texts]
        if len(self.words) > MEMO_WORDS:
            self.words = {}
        words = self.words
        missing = list(set().union(*(units for units, _ in split)) - words.keys())
        start = size = 0
        for i, word in enumerate(missing):
            size += len(word)
            if size >= batch_bytes or i + 1 == len(missing):
                part = [w.decode("utf-8", "replace") for w in missing[start : i + 1]]
                words.update(zip(missing[start : i + 1], map(len, self.model.encode(part, num_threads=1)), strict=True))
                start, size = i + 1, 0
        out = [sum(map(words.__getitem__, units)) + extra for units, extra in split]
        for word in missing:
            if len(word) > MEMO_BYTES:
                del words[word]
        return out


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One tokenizer per worker process, with its memo."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
