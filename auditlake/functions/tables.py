"""Table functions: whole documents as partitions of a table argument."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from .. import config as K
from ..operators import template as M

_HEADING = re.compile(M.HEADING, re.ASCII)
_NUMBERED = re.compile(r"(\.{3,}|…|\s)\s*[0-9]{1,3}\s*$", re.ASCII)
_TAIL = re.compile(r"(\.{3,}|…|\s[0-9]{1,3})\s*$", re.ASCII)


def _plausible(title: str) -> bool:
    letters = len(re.findall("[A-Za-zÄÖÜäöüß]", title))
    return bool(re.search("[A-Za-zÄÖÜäöüß]{4,}", title)) and not _TAIL.search(title) and letters >= max(3, 0.6 * len(title.replace(" ", "")))


def _follows(last: list[int], new: list[int]) -> bool:
    """The rule of ``template.follows`` on lists of numbers."""
    if not last:
        return len(new) <= 2 and 1 <= new[0] <= M.JUMP and min(new) >= 1
    if new[:-1] == last:
        return 1 <= new[-1] <= 2
    n = len(new)
    return n <= len(last) and new[:-1] == last[: n - 1] and 0 < new[-1] - last[n - 1] <= M.JUMP


class ChapterChunks:
    """Lines of one document in order -> its sections, none of which crosses a heading or a page.

    What is held is one page's lines: a page must be over before it is known whether it is
    a list of contents, whose lines are no headings.
    """

    def __init__(self) -> None:
        self.doc = self.page = None
        self.lines: list[str] = []
        self.last: list[int] = []
        self.chapter, self.n = "", 0

    def eval(self, row) -> Iterator[tuple]:
        self.doc = row["doc_id"]
        if row["page"] != self.page:
            yield from self._page()
            self.page = row["page"]
        self.lines.append(row["text"] or "")

    def terminate(self) -> Iterator[tuple]:
        yield from self._page()

    def _page(self) -> Iterator[tuple]:
        full = [x for x in self.lines if x.strip(" ")]
        rows = sum(bool(_NUMBERED.search(x)) for x in full)
        contents = rows >= 5 and rows >= 0.3 * len(full)
        held: list[str] = []
        for line in self.lines:
            head = None if contents else _HEADING.search(line)
            title = head and head.group(2).strip(" ")
            number = head and [int(x) for x in head.group(1).split(".")]
            if head and _plausible(title) and _follows(self.last, number):
                yield from self._sections(held)
                held, self.last, self.chapter = [], number, f"{head.group(1)} {title}"
            held.append(line)
        yield from self._sections(held)
        self.lines = []

    def _sections(self, lines: list[str]) -> Iterator[tuple]:
        blocks, open_ = [], ""
        for x in (x.strip(" ") for x in lines):
            if x:
                open_ = f"{open_} {x}" if open_ else x
                if len(open_) + 1 >= K.SECTION_TARGET:
                    blocks, open_ = [*blocks, open_], ""
            elif open_:
                blocks, open_ = [*blocks, open_], ""
        pieces = [b[i : i + K.SECTION_MAX].strip(" ") for b in [*blocks, open_] if b for i in range(0, len(b), K.SECTION_MAX)]
        merged: list[str] = []
        for p in pieces:
            if merged and min(len(p), len(merged[-1])) < K.SECTION_MIN:
                merged[-1] += f" {p}"
            else:
                merged.append(p)
        for text in merged:
            if len(text) >= K.SECTION_MIN:
                bare = not self.chapter or text.startswith(self.chapter[:20])
                yield self.doc, self.n, self.page, self.chapter, text if bare else f"[{self.chapter[:80]}] {text}"
                self.n += 1


def chapter_chunks(lines: DataFrame) -> DataFrame:
    """``template.chapter_sections(lines, with_title=True)`` as one pass of a table function over each document's lines: one shuffle and one sort, no windows or joins."""
    kind = dict(lines.dtypes)["doc_id"]
    made = udtf(ChapterChunks, returnType=f"doc_id {kind}, section_idx int, page int, chapter string, text string")
    return made(lines.asTable().partitionBy("doc_id").orderBy("page", "line"))
