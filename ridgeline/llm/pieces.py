"""Cutting texts into pieces that a byte-level tokenizer treats alike wherever they stand.

A text may be cut before a single blank that stands between two characters which are no white
space, and around a line break that does: no pretoken of the pattern crosses such a place. The
pieces repeat a great deal, so what a tokenizer makes of one is kept in a bounded memo.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

ADJACENT = re.compile(r"\s\s")
BLANK = re.compile(r"(?<=\S)(?= \S)")
BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")


def check_byte_level(path: str) -> None:
    """Raise for a tokenizer file that cuts or changes texts in another way than pieces() assumes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    marks = [x for x in spec.get("added_tokens") or [] if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") or x["content"].split() != [x["content"]]]
    if spec.get("normalizer") or not plain or marks or spec["model"].get("type") != "BPE":
        raise ValueError(f"{path} is not a plain byte-level vocabulary")


def pieces(text: str) -> list[str]:
    """Cut a text; joined, the pieces are the text again."""
    if not text:
        return []
    if "\0" in text or ADJACENT.search(text):
        return BLANK.split(text)
    return [p for p in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if p]


def sections(text: str, chars: int) -> Iterable[str]:
    """Consecutive parts of a text, each cut at the first place after so many characters where it may be cut."""
    start = 0
    while len(text) - start > chars and (at := BREAK.search(text, start + chars)):
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


class Memo:
    """What a function of lists of distinct pieces gives, kept for at most limit pieces."""

    def __init__(self, of_new: Callable[[list[str]], Iterable], limit: int = 400_000, longest: int = 64):
        self.of_new, self.limit, self.longest, self.kept = of_new, limit, longest, {}

    def __call__(self, lists: list[list[str]]) -> dict:
        """A dict that has every piece of the lists."""
        wanted = set().union(*lists) if lists else set()
        new = [p for p in wanted if p not in self.kept]
        if not new:
            return self.kept
        made = dict(zip(new, self.of_new(new), strict=True))
        if len(self.kept) + len(new) > self.limit:
            still = {p: self.kept[p] for p in wanted if p in self.kept}
            self.kept = still if len(still) < self.limit // 2 else {}
            made = still | made
        short = {p: v for p, v in made.items() if len(p) <= self.longest}
        if len(self.kept) + len(short) <= self.limit:
            self.kept.update(short)
        return self.kept if len(short) == len(made) and len(self.kept) >= len(made) else self.kept | made


def chunks(texts: list[str], chars: int = 2_000_000) -> Iterable[list[str]]:
    """Lists of consecutive texts with about so many characters; a longer text stands alone."""
    own, n = [], 0
    for x in texts:
        if own and n + len(x) > chars:
            yield own
            own, n = [], 0
        own.append(x)
        n += len(x)
    if own:
        yield own
