"""Whole texts to token ids with the tokenizers library.

A text is cut where its tokenizer always cuts (a space before a word, white space), the
pieces' ids are remembered, and only new pieces go through the library. Texts for which
such a cut isn't certain are encoded in one call: those with special tokens' signs (the
library's default gives a special token inside a text its own id), with white space other
than what a cut is made at, or with characters that tables of white space disagree on. The
memory for pieces is bounded and doesn't change results.
"""

import re

import numpy as np

from tidelog.llm.shared import worker_cache

PIECES = {"byte": 800_000, "word": 400_000}
BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Characters that Python and the tokenizers' patterns may not agree on as white space.
_DISPUTED = "\x1c-\x1f\u180e\u200b\ufeff"
_UNSURE_WORD = re.compile(f"[{_DISPUTED}]")
#: Those, and all white space but spaces and line breaks.
_UNSURE_BYTE = re.compile(f"[\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000{_DISPUTED}]")
#: Letters that lower-casing and normal forms map one to one, and ASCII signs other than the apostrophe.
_PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS = re.compile(f"[{_PLAIN}]+")
_WORD_SIGNS = re.compile(rf"([{_PLAIN}]+)([!-&(-/:-@\[-`{{-~]+)")


def _alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is a
    visible Latin-1 character, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _even(text: str) -> bool:
    """Each space or line break stands alone between two words, and no other white space does."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in ("", " ", "\n") or text[-1] in " \n":
        return False
    return not _UNSURE_BYTE.search(text)


class Encoder(dict):
    """Ids of pieces as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.lead, self.map = kind, " " if kind == "byte" else "", _alphabet()
        self.tokenize, self.mark = self.tokenizer.model.tokenize, self.lead.translate(self.map)
        self.coded = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, word: str) -> bytes:
        """A single run of letters goes to the model without the regular expressions around it."""
        spelled = word.encode().decode("latin-1").translate(self.map)
        return b"".join([self.coded[t.id] for t in self.tokenize(spelled)])

    def piece(self, p: str) -> bytes:
        """p begins with a line break if no space stood before it, and is bare otherwise; a
        zero character in front marks signs that follow letters."""
        if p[0] == "\0":
            return self.whole(p[1:])
        lead, word = ("", p[1:]) if p[0] == "\n" else (self.lead, p)
        if _LETTERS.fullmatch(word):
            return self.letters(lead + (word.lower() if self.kind == "word" else word))
        m = _WORD_SIGNS.fullmatch(word)
        return self[p[: len(p) - len(m[2])]] + self["\0" + m[2]] if m else self.whole(lead + word)

    def __missing__(self, p: str) -> bytes:
        if p.isascii() and p.isalpha():  # such letters stand for themselves
            out = b"".join([self.coded[t.id] for t in self.tokenize(self.mark + (p if self.kind == "byte" else p.lower()))])
        else:
            out = self.piece(p)
        if len(p) <= 64:
            if len(self) >= PIECES[self.kind]:
                self.clear()
            self[p] = out
        return out

    def ids(self, text: str) -> bytes:
        if "<|" in text or "\0" in text:
            return self.whole(text)
        if self.kind == "word":
            return self.whole(text) if _UNSURE_WORD.search(text) else b"".join(map(self.__getitem__, text.split()))
        if not _even(text):
            return self.whole(text)
        lines = [line.split(" ") for line in text.split("\n")]
        return self.line_break.join([self["\n" + x[0]] + b"".join(map(self.__getitem__, x[1:])) for x in lines])


def encoder(path: str | None, kind: str) -> Encoder:
    """The worker's encoder for a file; None stands for the installed public one."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(BYTE_FILE if kind == "byte" else WORD_FILE)
    cache = worker_cache()
    if (path, kind) not in cache:
        cache[path, kind] = Encoder(path, kind)
    return cache[path, kind]
