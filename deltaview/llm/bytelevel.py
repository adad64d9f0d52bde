"""What byte-level BPE files share: cutting texts where no token can reach across."""

from __future__ import annotations

import json
import re

import numpy as np
import regex

from deltaview.llm import bpe

#: Unicode White_Space, which the splitting pattern's \s stands for.
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the published splitting pattern of byte-level BPE vocabularies.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space that a cut can't hold: all but spaces and line feeds.
_RARE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c not in " \n" and regex.match(f"[{WHITE}]", c)) + "]")


def _can_be_cut(text: str) -> bool:
    """Whether spaces and line feeds are the only white space, no two of them side by side and none at an end."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text:
        return False
    if "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text):
        return False
    return not _RARE.search(text)


def cut_block(texts: list[str], known: dict) -> tuple[list[str], list[list[str]], list[str]]:
    """Texts cut before every space and line feed: what stands before the first one, the cuts
    after it (see whole), and the distinct cuts that aren't known.

    A space opens a new token, a lone line feed is one, and no token's look-ahead passes
    either, unless other white space is beside it or it ends the text; such a text is left
    whole, with no cuts. An added special token holds neither.
    """
    tails = [t.replace("\n", " \n").split(" ") if _can_be_cut(t) else [t] for t in texts]
    heads = [c.pop(0) for c in tails]
    return heads, tails, list(set().union(*tails).difference(known))


def split_heads(texts: list[str]) -> tuple[list[str], list[str | None]]:
    """The same cuts in another form: what stands before the first one, and the cuts after it,
    joined by spaces; None where there are none."""
    heads, bodies = [], []
    for t in texts:
        at = min((i for i in (t.find(" "), t.find("\n")) if i >= 0), default=-1) if _can_be_cut(t) else -1
        heads.append(t if at < 0 else t[:at])
        bodies.append(None if at < 0 else t[at:].replace("\n", " \n")[1:])
    return heads, bodies


def whole(cuts: list[str]) -> list[str]:
    """Cuts as they stand in a text: the space of those that a line feed doesn't open."""
    return [c if c[0] == "\n" else " " + c for c in cuts]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1 as itself, the
    rest from code point 256 on."""
    letters = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


def read_spec(path: str) -> dict:
    """A byte-level BPE file of the tokenizers library; raises unless cut_block holds for it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("only plain byte-level BPE files are read")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] or "\n" in a["content"] for a in spec["added_tokens"]):
        raise ValueError("added tokens must be plain strings without spaces and line feeds")
    return spec


class ByteLevel:
    """Vocabulary, merges and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = read_spec(path)
        model = spec["model"]
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        rank = np.arange(len(pairs))
        self.table = bpe.PairTable(left, right, rank, made)
        born = np.full(self.size, -1, np.int64)
        born[made] = rank
        self.monotone = bool((np.maximum(born[left], born[right]) < rank).all() and len(np.unique(made)) == len(made))

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and its number of added tokens."""
        if self.split_added is None or not self.split_added.search(text):
            return PATTERN.findall(text), 0
        parts = self.split_added.split(text)
        return [w for p in parts for w in PATTERN.findall(p)], len(parts) - 1

    def count(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        raw = [w.encode("utf-8", "replace") for w in words]
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return bpe.merge(symbols, np.array([len(r) for r in raw], np.int64), self.table, self.monotone)[1]
