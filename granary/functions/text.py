"""Strings: Unicode strip, marker cut, first sentence, prompts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() removes, as a regular expression class.
WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# An answer ends before the first of these.
MARKERS = ("\n", "Q:", "A:", "question:", "answer:", "Question:", "Answer:", "Questions:", "questions:", "QUESTION:", "ANSWER:", "REF", ".Forms", "http", "php", "Question", "Answer")

# Words before a full stop that do not end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "Gen", "Brig", "Adm", "Rear", "Lt", "Col", "Maj", "Capt", "St", "vs", "etc", "Fig", "Eq")

_INITIALS = re.compile(r"(?:[A-Za-z]\.){2,}")
_MARK = re.compile(r"\.\.\.|[.!?]")
_SOLID = re.compile(r"\S")

#: Length in words: runs of anything but space, tab and line breaks.
WORD_PATTERN = r"[^ \t\n\r]+"


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space (trim() knows the space alone)."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def marker_cut(answer: Column) -> Column:
    """Up to the first marker, stripped; the whole stripped answer if nothing is left.

    One leftmost alternation finds the least position of all markers.
    """
    either = "|".join(re.escape(m).replace("\n", "\\n") if m != "\n" else r"\n" for m in MARKERS)
    return F.coalesce(F.nullif(strip(F.regexp_replace(answer, f"(?s)(?:{either}).*", "")), F.lit("")), strip(answer))


def _next_solid(text: str, at: int) -> str:
    found = _SOLID.search(text, at)
    return found.group() if found else ""


def _token_before(text: str, i: int) -> str:
    """Letters and dots that stand before place i."""
    start = i
    while start and (text[start - 1] == "." or text[start - 1].isalpha()):
        start -= 1
    return text[start:i]


def ends_sentence(text: str, i: int) -> bool:
    """Whether the mark at i closes the sentence; only its neighbourhood decides."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if text[i] == ".":
        if before.isdigit() and after.isdigit():
            return False
        if before.isalpha() and after.isalpha() and text[i + 2 : i + 3] == ".":
            return False
    token = _token_before(text, i)
    if token in ABBREVIATIONS or ("." in token and _INITIALS.fullmatch(token + ".")):
        return False
    if token == "No":
        return not _next_solid(text, i + 1).isdigit()
    if len(token) == 1 and token.isascii() and token.isalpha():
        return not _next_solid(text, i + 1).isupper()
    return True


def first_sentence_of(text: str) -> str:
    """The first sentence of a text, or all of it; dots in threes never end one."""
    text = text.strip()
    stop = next((m.end() for m in _MARK.finditer(text) if len(m[0]) == 1 and ends_sentence(text, m.start())), None)
    return text if stop is None else text[:stop].strip()


def first_sentence(text: Column) -> Column:
    """The first sentence, in Arrow batches: the rules look back over runs of letters, which no built-in function does."""

    @F.pandas_udf("string")
    def sentences(texts: pd.Series) -> pd.Series:
        return texts.map(first_sentence_of, na_action="ignore")

    return sentences(text)


def truncate_answer(answer: Column) -> Column:
    """Marker cut, then first sentence."""
    return first_sentence(marker_cut(answer))


# The words of both prompts.
def qa_prompt(context: Column, question: Column) -> Column:
    head = "Answer the question as briefly as possible, based only on the context:\n Context:"
    return F.concat(F.lit(head), strip(context), F.lit("\n Question:"), strip(question), F.lit("\n Answer:"))


def summary_prompt(document: Column) -> Column:
    return F.concat(F.lit("Summarize the following document in one or two concise sentences.\nDocument:"), strip(document), F.lit("\nSummary:"))


def token_count(text: Column) -> Column:
    """Words of a text, the default tokenizer's count."""
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))


def two_parts(path: str) -> tuple[str, str]:
    """OWNER/NAME of a location, outer slashes aside; ValueError for anything else."""
    parts = path.strip("/").split("/")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"expected OWNER/NAME, got {path!r}")
    return parts[0], parts[1]
