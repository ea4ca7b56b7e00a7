"""Steps, presets and their settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

# The steps in their order.
STEPS = {
    1: "Analyze Structure", 2: "Extract Metadata", 3: "Remove Page Numbers", 4: "Remove Headers & Footers", 5: "Remove Front Matter", 6: "Remove Table of Contents", 7: "Remove Back Matter", 8: "Remove Index",
    9: "Remove Auxiliary Lists", 10: "Remove Citations", 11: "Remove Footnotes/Endnotes", 12: "Clean Special Characters", 13: "Reflow Paragraphs", 14: "Optimize Paragraph Length", 15: "Add Structure", 16: "Final Quality Review",
}


@dataclass(frozen=True)
class Settings:
    """What to do.  These defaults keep back matter; the default preset removes it."""

    extract_metadata: bool = True
    page_numbers: bool = True
    headers_footers: bool = True
    front_matter: bool = True
    table_of_contents: bool = True
    back_matter: bool = False
    index: bool = True
    auxiliary_lists: bool = False
    citations: bool = False
    footnotes: bool = False
    characters: bool = True
    reflow: bool = True
    paragraph_length: bool = True
    structure: bool = True
    max_paragraph_words: int = 250
    metadata_format: str = "yaml"
    chapter_style: str = "html_comments"
    end_style: str = "standard"
    chapters: bool = True
    strict_roman: bool = False
    strict_headers: bool = False
    heavy: bool = False
    #: Whether a document's kind of content rules out steps (`services.DISABLED_STEPS`).
    by_content: bool = False

    def enabled(self) -> tuple[int, ...]:
        """The first and the last step always run."""
        flags = (self.extract_metadata, self.page_numbers, self.headers_footers, self.front_matter, self.table_of_contents, self.back_matter, self.index, self.auxiliary_lists, self.citations, self.footnotes, self.characters, self.reflow, self.paragraph_length, self.structure)
        return (1, *(k for k, on in enumerate(flags, 2) if on), 16)


PRESETS = {
    "default": Settings(back_matter=True),
    "training": Settings(back_matter=True, auxiliary_lists=True, citations=True, footnotes=True, chapter_style="token", end_style="token"),
    "minimal": Settings(front_matter=False, table_of_contents=False, index=False, paragraph_length=False, max_paragraph_words=0, chapters=False, chapter_style="none", end_style="minimal"),
    "scholarly": Settings(index=False, auxiliary_lists=True, citations=True, footnotes=True, max_paragraph_words=300, heavy=True),
}


def preset(name: str, **changes) -> Settings:
    return replace(PRESETS[name], **changes)


def for_children(settings: Settings) -> Settings:
    """Shorter paragraphs, if paragraphs are changed at all."""
    return replace(settings, max_paragraph_words=min(settings.max_paragraph_words, 150)) if settings.paragraph_length else settings


def suggested(flags: Column) -> Column:
    """The preset that a document's kind suggests, null if none."""
    sure = flags["confidence"] >= 0.7
    return F.when(sure & flags["is_academic"], "scholarly").when(sure & (flags["primary_type"] == "poetry"), "minimal").when(sure & flags["is_legal"], "scholarly")
