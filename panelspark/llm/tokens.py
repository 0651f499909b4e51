"""Whole texts to token ids with the tokenizers library, one library call for each different word.

A text is cut where no pre-token of the vocabulary can cross, so that the ids of
the cuts in a row are the ids of the text.  Only cuts that a worker has not met
lately go to the library; their ids come from a table after that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession

from panelspark.llm.common import kept_by_worker

#: Cuts whose ids a worker keeps; those not met since half as many others came are dropped.
CACHE_ENTRIES = 1_000_000

#: Words that go to the library in one string.
ROW_WORDS = 32

#: A longer text is cut before it is taken apart.
LONG_TEXT = 1 << 20

#: The code points that both vocabularies' patterns take as white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A byte-level cut: a word with the one space before it, or a run of white space that leaves the
#: last space to the next word.
BYTE_LEVEL_CUT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: White space but space and line end.
OTHER_SPACE = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Where a long text may be cut for either kind.
SINGLE_SPACE = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def read_vocabulary(path: str) -> str:
    """The text of a tokenizer file; small and of fixed size, so it may be sent to every worker."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def segments(text: str) -> Iterator[str]:
    """``text`` in parts of about LONG_TEXT code points, cut before a single space."""
    start = 0
    while len(text) - start > LONG_TEXT:
        match = SINGLE_SPACE.search(text, start + LONG_TEXT)
        if match is None:
            break
        yield text[start:match.start()]
        start = match.start()
    yield text[start:] if start else text


def split_spaced(text: str) -> list[str]:
    """Cuts for vocabularies that drop white space; an empty cut has no ids."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def split_byte_level(text: str) -> list[str]:
    """Cuts for vocabularies of bytes.

    Where each white space is one space or line end between words, plain splitting gives the same cuts as the
    pattern, but for empty ones, which have no ids.
    """
    if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or OTHER_SPACE.search(text)):
        return BYTE_LEVEL_CUT.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def gaps(row: list[bytes | None]) -> list[int]:
    """The places of None."""
    out, at = [], -1
    for _ in range(row.count(None)):
        out.append(at := row.index(None, at + 1))
    return out


class Known(dict):
    """Ids by cut; a cut that is asked for in vain is noted, or taken from ``before``, and has None until ``learn``.

    A comma or full stop behind a letter is a pre-token of its own, so such a cut is made of its parts.
    """

    def __init__(self, before: dict[str, bytes]) -> None:
        self.before = before
        self.missing: list[str] = []
        self.stopped: list[str] = []

    def __missing__(self, cut: str) -> bytes | None:
        ids = self[cut] = self.before.get(cut)
        if ids is not None:
            return ids
        if cut[-1:] in (",", ".") and cut[-2:-1].isalpha() and cut[-2:-1].lower().isalpha():  # it may be folded first
            self.stopped.append(cut)
            self[cut[:-1]], self[cut[-1]]  # noqa: B018  asked for, so that they are learnt
        else:
            self.missing.append(cut)
        return None

    def learn(self, library: Callable[[list[str]], list[bytes]]) -> None:
        self.update(zip(self.missing, library(self.missing), strict=True))
        for cut in self.stopped:
            self[cut] = self[cut[:-1]] + self[cut[-1]]
        self.missing, self.stopped = [], []


class Encoder:
    """Ids of texts as bytes, two or four a token (little-endian).

    Texts that hold one of the vocabulary's special strings go to the library
    whole, since such a string also ends the white space before it.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        drops_space = '"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true' not in (
            vocabulary.replace(" ", "").replace("\n", ""))
        self.spaced = drops_space
        self.cuts = split_spaced if drops_space else split_byte_level
        names = [self.tokenizer.id_to_token(i) or "" for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.edge = np.array([name.endswith("</w>") if drops_space else name.startswith("\u0120") for name in names])
        self.known = Known({})

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, self.dtype).tobytes() for one in encoded]

    def _words(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut; single words go to the library in rows, which costs less than one by one.

        Each word of a row has at least one token with the vocabulary's mark of a word's edge, so a row
        with as many marks as words is cut at them without doubt; any other goes there word by word.
        """
        plain = [cut for cut in cuts if (cut.isalpha() if self.spaced else cut[:1] == " " and cut[1:].isalpha())]
        rows = [plain[i:i + ROW_WORDS] for i in range(0, len(plain), ROW_WORDS)]
        found: dict[str, bytes] = {}
        width = self.dtype.itemsize
        for row, raw in zip(rows, self._library([(" " if self.spaced else "").join(row) for row in rows]), strict=True):
            edges = np.flatnonzero(self.edge[np.frombuffer(raw, self.dtype)])
            if len(edges) == len(row):
                bounds = np.append(0, edges + 1) if self.spaced else np.append(edges, len(raw) // width)
                at = (bounds * width).tolist()
                found.update((word, raw[at[i]:at[i + 1]]) for i, word in enumerate(row))
        rest = [cut for cut in cuts if cut not in found]
        found.update(zip(rest, self._library(rest), strict=True))
        return [found[cut] for cut in cuts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the texts together should be a few MB."""
        if len(self.known) > CACHE_ENTRIES // 2:
            self.known.before = {}
            self.known = Known(self.known)
        known = self.known
        out: list[list[bytes]] = []
        open_parts: list[tuple[list[bytes | None], list[tuple[int, str]]]] = []
        for text in texts:
            out.append(ids := [])
            if self.special.search(text):
                ids += self._library([text])
                continue
            for part in segments(text):
                cuts = self.cuts(part)
                first = len(ids)
                ids += map(known.get, cuts)
                if found := gaps(ids[first:] if first else ids):
                    open_parts.append((ids, [(first + at, cuts[at]) for at in found]))
        for _, found in open_parts:
            for _, cut in found:
                known[cut]  # noqa: B018  asked for, so that it is learnt
        known.learn(self._words)
        for ids, found in open_parts:
            for at, cut in found:
                ids[at] = known[cut]
        return [b"".join(ids) for ids in out]


def shared_encoder(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """A function that gives a worker's encoder for the tokenizer file at ``path`` of the driver."""
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    name = f"encoder:{path}"
    return lambda: kept_by_worker(name, lambda: Encoder(vocabulary.value))
