"""Rulers in subword tokens: WordPiece over a vocabulary, and whatever tokenizer file the encoder has.

A ruler cuts a text into the slices that its tokens cover; the slices join to the text again. Each keeps what stands before its token and was in none, the last also what follows.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Ruler = Callable[[str], list[str]]


def _slices(text: str, ends: list[int]) -> list[str]:
    if not ends:
        return []
    ends = [*ends[:-1], len(text)]
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class WordPiece:
    """Longest match first: a word gives the longest entry that begins it, then the longest continuing one (``##`` before it in the vocabulary), and so on.

    Words are runs between white space; punctuation and symbols stand by themselves. A word that cannot be cut whole, or is longer than ``longest``, is one unknown token. With
    ``lower`` letters are folded and accents dropped, as the vocabulary then expects. The vocabulary is a trie, so a match reads each character once.
    """

    def __init__(self, vocabulary: list[str], unknown: str = "[UNK]", lower: bool = True, longest: int = 100):
        self.vocabulary, self.lower, self.longest = vocabulary, lower, longest
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        if unknown not in self.ids:
            raise ValueError(f"the vocabulary has no {unknown}")
        self.unknown = self.ids[unknown]
        self.first: dict = {}
        self.later: dict = {}
        for token, number in self.ids.items():
            node = self.later if token.startswith("##") and len(token) > 2 else self.first
            for c in token[2:] if node is self.later else token:
                node = node.setdefault(c, {})
            node[""] = number

    def _fold(self, c: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn") if self.lower else c

    def _words(self, text: str) -> Iterator[tuple[int, int]]:
        start = None
        for i, c in enumerate(text):
            alone = unicodedata.category(c)[0] in "PS"
            if (c.isspace() or alone) and start is not None:
                yield start, i
                start = None
            if alone:
                yield i, i + 1
            elif not c.isspace() and start is None:
                start = i
        if start is not None:
            yield start, len(text)

    def _cut(self, folded: str, owners: list[int]) -> list[tuple[int, int]] | None:
        """(id, end in the word as written) of a word's tokens; None where no cut covers it."""
        out, at = [], 0
        while at < len(folded):
            node, best = self.later if at else self.first, None
            for i in range(at, len(folded)):
                node = node.get(folded[i])
                if node is None:
                    break
                if "" in node:
                    best = (node[""], i + 1)
            if best is None:
                return None
            number, at = best
            out.append((number, owners[at - 1] + 1))
        return out

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and from where to where in the text each stands."""
        ids, spots = [], []
        for start, stop in self._words(text):
            folded, owners = [], []
            for i in range(start, stop):
                for x in self._fold(text[i]):
                    folded.append(x)
                    owners.append(i)
            if not folded:
                continue
            cut = self._cut("".join(folded), owners) if stop - start <= self.longest else None
            for number, end in cut or [(self.unknown, stop)]:
                ids.append(number)
                spots.append((start, end))
                start = end
            spots[-1] = (spots[-1][0], stop)
        return ids, spots

    def decode(self, ids: list[int]) -> str:
        """Words with a space between them; continuing tokens join the one before."""
        tokens = [self.vocabulary[i] for i in ids]
        return "".join(t[2:] if t.startswith("##") and len(t) > 2 else f" {t}" for t in tokens)[1:] if tokens else ""

    def __call__(self, text: str) -> list[str]:
        return _slices(text, [e for _, e in self.encode(text)[1]])


def read_vocabulary(path: str) -> list[str]:
    """One entry a line, read on the driver."""
    with open(path, encoding="utf-8") as lines:
        return [x.rstrip("\n") for x in lines]


def wordpiece_ruler(vocabulary: list[str], **settings) -> Callable[[], Ruler]:
    """A maker of rulers for ``recursive_chunks``; the vocabulary goes along with the plan, its size is independent of the corpus."""
    return lambda: WordPiece(vocabulary, **settings)


def _spaces_end_tokens(made: dict) -> bool:
    """Whether no token goes from one run of characters between spaces into the next: byte-level pieces by the library's own pattern, and nothing that changes texts before or after."""
    before, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
    own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not made.get("normalizer") and all(t["special"] for t in added)
    return own and made["model"]["type"] == "BPE" and not made.get("truncation")


def tokenizer_ruler(path: str) -> Callable[[], Ruler]:
    """The same for a file of the tokenizers library, read on the driver."""
    with open(path, encoding="utf-8") as f:
        made = f.read()
    bounded = _spaces_end_tokens(json.loads(made))

    def make() -> Ruler:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_str(made)
        tokenizer.encode_special_tokens = True

        def ruler(text: str) -> list[str]:
            ends, far = [], 0
            for _, e in tokenizer.encode(text, add_special_tokens=False).offsets:
                far = max(far, e)
                ends.append(far)
            return _slices(text, ends)

        ruler.counts = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if bounded:
            ruler.least = lambda text: sum(map(bool, text.split(" ")))
        return ruler

    return make


def ruled_windows(pages: DataFrame, size: int, overlap: int, make_ruler: Callable[[], Ruler]) -> DataFrame:
    """(doc_name, page_number, local_index, text, n_tokens): windows of ``size`` of the ruler's tokens, ``overlap`` shared, as they stand in the page; blank ones drop out.

    Null and blank pages have none. Pages are independent, so there is no shuffle.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ruler = make_ruler()
        for f in frames:
            out = []
            for doc, page, text in zip(f["doc_name"], f["page_number"], f["text"]):
                tokens, local = ruler(text or ""), 0
                for i in range(0, max(len(tokens) - overlap, 1), size - overlap):
                    body = "".join(tokens[i : i + size]).strip()
                    if body:
                        out.append((doc, page, local, body, len(tokens[i : i + size])))
                        local += 1
            yield pd.DataFrame(out, columns=["doc_name", "page_number", "local_index", "text", "n_tokens"])

    return pages.select("doc_name", "page_number", "text").mapInPandas(work, "doc_name string, page_number int, local_index int, text string, n_tokens int")
