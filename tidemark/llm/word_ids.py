"""Token ids of whole texts by the tokenizers library, each new word once per worker.

Both public tokenizers cut a text before any single space that stands between two other characters, whatever comes
further on, so the ids of a text are those of its words in a row. A word is met again far more often than a new one
comes up. Arrow cuts a group of texts, numbers its distinct words and lays their ids out again in the texts' order, so
Python meets a word once per group; each Python worker holds the ids of words in two dictionaries of bounded size. When
the newer is full it becomes the older, from which words that are met again move over, so frequent words stay at hand.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer pieces aren't kept in the dictionary.
LONGEST_KEPT = 60
#: Texts are cut into blocks of about so many characters, to bound the memory that a very long one takes.
BLOCK = 1 << 20
#: Bytes of texts whose words are learnt together.
GROUP = 4 << 20
#: Letters that any version of Unicode takes for composed ones with one letter as lower case.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_latin = re.compile(f"[{_LATIN}]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for a byte: printable ones for themselves, then others in a row."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_LETTERS = _byte_letters()


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes.

    ``spaced``: a word's preceding space is part of its token (byte-level tokenizers that keep white space); else
    white space only separates words.
    """

    def __init__(self, tokenizer_path: str, spaced: bool, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already has a worker on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: A mark before a letter in each: none is part of a word of letters with marks behind them.
        self.marked_specials = all(re.search(r"[^\w\s].*\w", x) for x in self.special)
        self.spaced, self.limit = spaced, limit
        #: Runs of letters, those that follow a line feed with it in front; other words with a space in front.
        self.words: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        #: Runs of punctuation after letters, and first words.
        self.pieces: dict[str, bytes] = {}
        probes = ["a" + chr(c) + "Ab" for c in range(0x180) if _latin(chr(c))]
        #: Whether the tokenizer's model gives the ids of Latin letters without what stands around it.
        self.direct = all([self._run(x, before) for x in probes] == self._runs(probes, before) for before in (" \n" if spaced else " "))

    def _exact(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _kept(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            ids = self._exact(piece) if piece else b""
            if len(piece) <= LONGEST_KEPT:
                if len(self.pieces) > self.limit:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _plain(self, letters: str) -> bool:
        """One run of letters, before and after the tokenizer's normalizer, which makes letter and mark of some."""
        if not letters.isalpha():
            return False
        return self.spaced or letters.isascii() or unicodedata.normalize("NFC", letters).lower().isalpha()

    def _run(self, letters: str, before: str) -> bytes:
        """Of a run of Latin letters, by the model alone."""
        if not self.spaced:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_LETTERS)
        first = b""
        if self.spaced and before == " ":
            letters = _LETTERS[ord(" ")] + letters
        elif self.spaced:
            first = self._kept(before)
        return first + array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()

    def _runs(self, runs: list[str], before: str) -> list[bytes]:
        """Of runs of letters, each with ``before`` in front of it; one call for all, as the tokenizer cuts between them."""
        found = self.tokenizer.encode(before + before.join(runs), add_special_tokens=False)
        places, step = found.word_ids, 2 if before == "\n" else 1
        if places[-1] != step * len(runs) - 1:  # a run that the tokenizer cuts further
            return [self._exact(before + run) for run in runs]
        starts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)][::step]
        data = array("I", found.ids).tobytes()
        return [data[4 * i : 4 * j] for i, j in zip(starts, starts[1:])]

    def _other(self, word: str) -> bytes | None:
        """None: the word's ids depend on what stands beside it."""
        if not self.spaced:
            return self._exact(word) if word else b""
        inner = word[1:] if word[:1] == "\n" else word
        if not inner or inner[0].isspace() or inner[-1].isspace():
            return None
        return self._exact(word if inner is not word else " " + word)

    def _looked_up(self, words: list[str]) -> list[bytes | None]:
        """Ids of distinct words; those that are new, and not too long, are put into the dictionary without punctuation behind them."""
        if len(self.words) > self.limit:
            self.older, self.words = self.words, {}
        known, older, pieces = self.words, self.older, self.pieces
        free_of_special = lambda word: self.marked_specials or not any(x in word for x in self.special)
        out: list[bytes | None] = []
        late: list[tuple[int, str]] = []
        for at, word in enumerate(words):
            body = word.rstrip(string.punctuation)
            ids = known.get(body)
            if ids is not None and len(body) < len(word):
                tail = pieces.get(word[len(body) :])
                ids = ids + tail if tail is not None and self.marked_specials and len(word) <= LONGEST_KEPT else None
            if ids is None:
                late.append((at, body))
            out.append(ids)
        runs: dict[str, dict[str, str]] = {" ": {}, "\n": {}}
        plain = []
        for at, body in late:
            word = words[at]
            before = "\n" if self.spaced and body[:1] == "\n" else " "
            letters = body[1:] if before == "\n" else body
            if len(word) > LONGEST_KEPT:
                out[at] = self._other(word)
            elif self._plain(letters) and free_of_special(word):
                plain.append((at, body))
                if body not in known:
                    if (ids := older.get(body)) is None and self.direct and _latin(letters):
                        ids = self._run(letters, before)
                    if ids is None:
                        runs[before][letters] = body
                    else:
                        known[body] = ids
            else:
                key = " " + word
                if key not in known:
                    known[key] = older[key] if key in older else self._other(word)
                out[at] = known[key]
        for before, found in runs.items():
            for at in range(0, len(found), 1000):
                some = list(found)[at : at + 1000] if len(found) > 1000 else list(found)
                for letters, ids in zip(some, self._runs(some, before)):
                    known[found[letters]] = ids
        for at, body in plain:
            out[at] = known[body] + self._kept(words[at][len(body) :])
        return out

    def _group(self, texts: pa.Array) -> list[bytes]:
        """Of blocks; the distinct words of all of them are looked up together."""
        has = lambda x: pc.match_substring(texts, x)
        if self.spaced:  # a line feed is cut off like a space where it stands between two other characters
            exact = has(" \n")
            alone = pc.invert(pc.or_(pc.or_(has("\n\n"), has("\n ")), pc.or_(pc.starts_with(texts, "\n"), pc.ends_with(texts, "\n"))))
            cut = pc.if_else(exact, pa.scalar("", texts.type), pc.if_else(alone, pc.replace_substring(texts, "\n", " \n"), texts))
            lists = pc.split_pattern(cut, " ")
            firsts = [self._kept(x) for x in pc.list_element(lists, 0).to_numpy(zero_copy_only=False)]  # no space before it
            lists = pc.list_slice(lists, 1)
            whole = set(np.flatnonzero(exact.to_numpy(zero_copy_only=False)).tolist())
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            firsts, whole = [b""] * len(texts), set()
        words, starts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        values = pa.array(self._looked_up(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        laid = values.take(words.indices)
        if laid.null_count:  # words whose ids depend on the white space beside them
            nulls = np.flatnonzero(laid.is_null().to_numpy(zero_copy_only=False))
            whole.update((np.searchsorted(starts - starts[0], nulls, "right") - 1).tolist())
        _, places, data = laid.buffers()
        data = memoryview(data) if data is not None and len(laid) else memoryview(b"")
        at = np.frombuffer(places, "<i8", len(laid) + 1)[starts - starts[0]].tolist() if len(laid) else [0] * len(starts)
        return [self._exact(texts[i].as_py()) if i in whole else b"".join((firsts[i], data[at[i] : at[i + 1]])) for i in range(len(texts))]

    def _blocks(self, text: str) -> Iterator[str]:
        """Cut before a space between two characters that aren't white space; the space stays with the second block."""
        at = 0
        while len(text) - at > 2 * BLOCK:
            cut = text.find(" ", at + BLOCK)
            while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut <= 0 or cut >= len(text) - 1:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def ids(self, text: str) -> bytes:
        return b"".join(self._group(pa.array([block], pa.large_string()))[0] for block in self._blocks(text))

    def many(self, texts: pa.Array, rows: int = 10_000) -> Iterator[bytes]:
        """Of a column of texts, some at a time; a long one by itself."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="i8")
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + GROUP, "right"))))
            if ends[end - 1] - before > GROUP:
                yield self.ids(texts[at].as_py())
            else:
                yield from self._group(texts.slice(at, end - at))
            at = end


_OPEN: dict[tuple[str, bool], WordIds] = {}


def word_ids(tokenizer_path: str, spaced: bool) -> WordIds:
    """The worker's own; kept from task to task."""
    key = (tokenizer_path, spaced)
    if key not in _OPEN:
        _OPEN[key] = WordIds(tokenizer_path, spaced)
    return _OPEN[key]
