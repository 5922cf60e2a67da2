"""Pre-tokenization as native expressions: texts to arrays of chunks by the model's own regexes.

Every stage is an isolating split: matches are pieces, and so are the gaps between them.  In one
regular expression that is the stage's pattern or else the longest run of characters at which it
doesn't match, so ``regexp_extract_all`` yields all pieces and no Python is needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.normalize import MARK

LETTER, NUMBER, MARKS = r"\p{L}", r"\p{N}", r"\p{M}"
_TRAILING = [r"\s+(?!\S)", r"\s+"]
_SHORT = [f"'{a}{b}".replace(" ", "") for a, b in (("[sS]", ""), ("[tT]", ""), ("[rR]", "[eE]"), ("[vV]", "[eE]"), ("[mM]", ""), ("[lL]", "[lL]"), ("[dD]", ""))]


def word_grammar() -> str:
    """Lower-case contractions; runs of letters, numbers or symbols, each with one leading blank."""
    runs = [f" ?{kind}+" for kind in (LETTER, NUMBER, f"[^\\s{LETTER}{NUMBER}]")]
    return "|".join(["'(?:ll|re|ve|[dmst])", *runs, *_TRAILING])


def generic_grammar(digits: int = 3, marks: bool = False, breaks: str = r"\s*[\r\n]+") -> str:
    """Contractions in either case; letters with one leading other character; capped digit runs."""
    letters = f"[{LETTER}{MARKS}]+" if marks else f"{LETTER}+"
    apart = LETTER + (MARKS if marks else "") + NUMBER
    number = NUMBER + ("+" if digits == 0 else "" if digits == 1 else f"{{1,{digits}}}")
    return "|".join([*_SHORT, f"[^\\r\\n{LETTER}{NUMBER}]?{letters}", number, f" ?[^\\s{apart}]+[\\r\\n]*", breaks, *_TRAILING])


def camel_grammar(digits: int = 3, contractions: bool = True) -> str:
    """Case-aware letter runs, with a contraction as ending if asked."""
    upper, lower = (f"[{a}\\p{{Lm}}\\p{{Lo}}{MARKS}]" for a in (r"\p{Lu}\p{Lt}", r"\p{Ll}"))
    end = f"(?:{'|'.join(_SHORT)})?" if contractions else ""
    lead = f"[^\\r\\n{LETTER}{NUMBER}]?"
    number = NUMBER + ("+" if digits == 0 else "" if digits == 1 else f"{{1,{digits}}}")
    return "|".join([f"{lead}{upper}*{lower}+{end}", f"{lead}{upper}+{lower}*{end}", number, f" ?[^\\s{LETTER}{NUMBER}]+[\\r\\n/]*", r"\s*[\r\n]+", *_TRAILING])


def _ascii_cases(m: re.Match) -> str:
    body = re.sub(r"[A-Za-z]", lambda x: f"[{x.group().lower()}{x.group().upper()}]", m.group(1))
    return f"(?:{body})"


_SCRIPTS = "Han Hiragana Katakana Hangul Thai Cyrillic Arabic Latin Greek Hebrew Devanagari Bopomofo".split()


def to_java(pattern: str) -> str:
    """The pattern for the engine that Spark uses.

    Contractions in either case mean ASCII letters only; scripts are spelt Java's way.  Anchors to the
    whole input mean something else inside a piece, and class intersections differ: both raise.
    """
    if re.search(r"(?<!\\)(?:\\\\)*\\[AGzZ]", pattern):
        raise ValueError(f"a split pattern with an anchor to the whole text isn't supported: {pattern!r}")
    if re.search(r"\[[^\]]*&&", pattern):
        raise ValueError(f"a split pattern with a class intersection isn't supported: {pattern!r}")
    pattern = re.sub(r"\(\?i:((?:'?[A-Za-z]+\|)*'?[A-Za-z]+)\)", _ascii_cases, pattern)
    for name in _SCRIPTS:
        pattern = re.sub(rf"\\([pP])\{{(?:Script=|sc=)?{name}\}}", rf"\\\1{{Is{name}}}", pattern)
    return pattern


def stage_pattern(pattern: str) -> str:
    """One expression for the pieces of a split: its matches, and the gaps between them."""
    java = to_java(pattern)
    return f"(?U)(?:{java})|(?:(?!(?:{java}))[\\s\\S])+"


def isolate(text: Column, stages: tuple[str, ...]) -> Column:
    """Pieces of a text after all stages, none of which may match the empty text."""

    def split(pattern: str) -> Callable[[Column], Column]:
        return lambda piece: F.regexp_extract_all(piece, F.lit(stage_pattern(pattern)), F.lit(0))

    def again(pattern: str) -> Callable[[Column], Column]:
        # A piece of one character is a match or a gap, so it stays; splits by classes leave many.
        return lambda piece: F.when(F.char_length(piece) == 1, F.array(piece)).otherwise(split(pattern)(piece))

    pieces: Column | None = None
    for pattern in stages:
        pieces = split(pattern)(text) if pieces is None else F.flatten(F.transform(pieces, again(pattern)))
    if pieces is None:
        return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.array(text))
    return pieces


#: Pieces of marks and the non-marks behind them; trailing marks are a piece of their own.
MARK_PIECES = f"{MARK}*[^{MARK}]+|{MARK}+"


def at_marks(text: Column) -> Column:
    """The pieces of a text with space marks."""
    return F.regexp_extract_all(text, F.lit(MARK_PIECES), F.lit(0))


def check_pattern(spark, pattern: str) -> None:
    """Raises ValueError if the pattern doesn't compile, or matches the empty text (its empty matches
    would hide the gaps)."""
    compiler = spark._jvm.java.util.regex.Pattern
    try:
        compiler.compile(stage_pattern(pattern))
        empty = compiler.compile(f"(?U){to_java(pattern)}").matcher("").find()
    except Exception as error:
        raise ValueError(f"the split pattern doesn't compile: {pattern!r}") from error
    if empty:
        raise ValueError(f"a split pattern that matches the empty text isn't supported: {pattern!r}")
