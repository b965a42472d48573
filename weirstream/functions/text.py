"""Column expressions over text: character classes, windows and counts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Script ranges in order of precedence, without the digits that lie in them.
SCRIPTS = {
    "cjk": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}",
    "kana": r"\x{3040}-\x{30FF}",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "arabic": r"\x{0600}-\x{065F}\x{066A}-\x{06EF}\x{06FA}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "devanagari": r"\x{0900}-\x{0965}\x{0970}-\x{097F}",
    "thai": r"\x{0E00}-\x{0E4F}\x{0E5A}-\x{0E7F}",
    "hebrew": r"\x{0590}-\x{05FF}",
    "greek": r"\x{0370}-\x{03FF}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "latin": r"A-Za-z\x{0080}-\x{0084}\x{0086}-\x{009F}\x{00A1}-\x{00B1}\x{00B4}-\x{00B8}\x{00BA}-\x{024F}",
}
#: Characters that count as digits beyond decimal numbers (superscripts, subscripts, circled and the like).
DIGITS = r"\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
#: White space, and ASCII characters that are neither alphanumeric nor white space.
SPACES = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SYMBOLS = r"\x{0000}-\x{0008}\x{000E}-\x{001B}!-/:-@\[-`{-~\x{007F}"
#: Traces of documents and code that leak into prose.
ARTEFACTS = [r"#{3,}", r"```", r"\bpip install\b", r"\bnpm install\b", r"#REF!", r"#DIV/0!", r"#VALUE!", r"https?://\S+", r"[A-Za-z]:\\\\", r"\.py\b|\.env\b|\.json\b", r"\d{4}年\d{1,2}月", r"={4,}", r"─{4,}", r"_{6,}"]
#: Fixed value: runs of these characters are layout, not collapse.
RUN_EXCLUDED = "-=─_*#~•.│ \t\n"
EXPECTED = ("latin", "cyrillic")
LETTERS = "".join(SCRIPTS.values())
WORD = r"[\p{L}\p{Nl}\p{No}]{2,}"
NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"


def one_of(ranges: str) -> str:
    return f"[{ranges}]"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def char_class(ch: Column) -> Column:
    """Class of one character: digit, space, symbol, a script, or other; the first that fits."""
    out = F.when(ch.rlike(one_of(DIGITS)), "digit").when(ch.rlike(one_of(SPACES)), "space").when(ch.rlike(one_of(SYMBOLS)), "symbol")
    for name, ranges in SCRIPTS.items():
        out = out.when(ch.rlike(one_of(ranges)), name)
    return out.otherwise("other")


def foreign(expected: tuple[str, ...] = EXPECTED) -> str:
    return "".join(r for name, r in SCRIPTS.items() if name not in expected)


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def window_at(text: Column, position: Column, size: int | Column) -> Column:
    """The last ``size`` characters of the first ``position`` ones."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.substring(text, F.greatest(position - size, F.lit(0)) + 1, F.least(position, size))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text as doubles rounded to three places; a comma is a decimal point."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.round(F.replace(n, F.lit(","), F.lit(".")).cast("double"), 3)))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high`` on, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))
