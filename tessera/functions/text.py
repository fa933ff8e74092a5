"""Column expressions over subtitle text; Java regular expressions with Python's Unicode classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
#: Letters and digits that bound a word: ASCII, Latin supplements and extensions.
LATIN = "A-Za-z0-9À-ɏḀ-ỿ"
#: The same without digits.
LATIN_LETTER = "A-Za-zÀ-ɏḀ-ỿ"
#: Kana, CJK ideographs and extension A, Hangul syllables.
CJK = "぀-ヿ㐀-䶿一-鿿가-힯"
#: Letters that only Vietnamese has; tone letters in lower case, the others in both.
VIETNAMESE = "ăâđêôơưĂÂĐÊÔƠƯạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
# Names of keys, and what joins them.
MODIFIERS = ["ctrl", "control", "shift", "alt", "cmd", "command", "option", "win"]
PLAIN_KEYS = ["tab", "enter", "esc", "space"]
MORE_KEYS = ["return", "delete", "del", "backspace", "home", "end"]
OTHER_KEYS = [r"f\p{Nd}{1,2}", "[a-z0-9]"]
SPOKEN_PLUS = ["cộng", "plus", "và"]
JOINERS = [r"\+", "＋", "加", "plus", "cộng"]

# The forms of a timing line, of markup, and of a Latin term.
CLOCK = r"\p{Nd}{1,2}:\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}{1,3}"
TIMING = rf"(?U)^\s*({CLOCK})\s*-->\s*({CLOCK})"
SPACE = r"(?U)^\s+|\s+$"
CJK_LEFT = f"[{CJK}]"
VIETNAMESE_LEFT = f"[{VIETNAMESE}]"
MARKUP = r"(?imdU)```|\*\*|^#{1,6}\s|^>\s|translated by|bản dịch bởi"


def either(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


# A shortcut that is spelled out, what joins keys, and a key combination.
SPELLED_SHORTCUT = rf"(?iuU)(?<![a-z]){either(MODIFIERS)}\s*(?:{either(SPOKEN_PLUS)}\s+(?={either(MODIFIERS + PLAIN_KEYS + OTHER_KEYS)}(?!\w))|加)"
JOIN = rf"\s*{either(JOINERS)}\s*"
COMBO = rf"(?iuU)(?<![a-z])(?:{either(MODIFIERS)}{JOIN})+{either(MODIFIERS + PLAIN_KEYS + MORE_KEYS + OTHER_KEYS)}(?![a-z])"
LATIN_TERM = rf"[{LATIN_LETTER}][{LATIN}+#]*(?:[.\-][{LATIN}+#]+)*"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, SPACE, "")


def joined(lines: Column, sep: str = " / ", trimmed: bool = True) -> Column:
    """A block's lines as one string."""
    return F.array_join(F.transform(lines, strip) if trimmed else lines, sep)


def loose_key(lines: Column) -> Column:
    """Letters and digits of all lines in lower case: what is left when layout and punctuation don't count."""
    return F.lower(F.regexp_replace(F.array_join(lines, ""), r"[^\p{L}\p{N}]+", ""))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def one_digit(number: Column) -> Column:
    """A number from 0 to 2^31 with one digit behind the point: its exact binary value, rounded half to even.

    The fraction, a double that is exact, is compared with twentieths in whole numbers of 2^-52 and a rest
    below that; a product with 20 of either is exact.
    """
    unit = 1 << 52

    def split(x: Column) -> Column:
        units = (x - F.floor(x)) * unit
        return F.struct(F.floor(x).alias("whole"), F.floor(units).alias("full"), ((units - F.floor(units)) * 20).alias("rest"))

    def halves(x: Column) -> Column:
        scaled = x["full"] * 20 + F.floor(x["rest"])
        half = F.shiftright(scaled, 52).cast("long")  # twentieths
        exact = (half * unit == scaled) & (x["rest"] == F.floor(x["rest"]))
        return F.struct(x["whole"].alias("whole"), half.alias("half"), exact.alias("exact"))

    def rounded(x: Column) -> Column:
        odd, down = x["half"] % 2 == 1, F.shiftright(x["half"], 1)
        up = odd & (~x["exact"] | (down % 2 == 1))
        return x["whole"] * 10 + down + up.cast("long")

    shown = lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))
    return let(let(let(let(number, split), halves), rounded), shown)


def is_number(text: Column) -> Column:
    return text.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$")


def timing_end(timing: Column) -> Column:
    return F.when(timing.rlike(TIMING), F.regexp_extract(timing, TIMING, 2)).otherwise("?")


def clock_seconds(clock: Column) -> Column:
    part = F.split(F.translate(clock, ",", "."), ":")
    return part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("double")


def duration(timing: Column) -> Column:
    """Seconds between both clocks; null if they can't be read."""
    ends = [clock_seconds(F.regexp_extract(timing, TIMING, i)) for i in (1, 2)]
    return F.when(timing.rlike(TIMING), ends[1] - ends[0])


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition, which has no built-in; the one Python function of the engine.

    Only text beyond ASCII goes to Python: the rest is its own composition.
    """

    @F.pandas_udf("string")
    def normal(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return F.coalesce(normal(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def numbers(normal: Column) -> Column:
    """Distinct digit runs."""
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(r"\p{Nd}+"), F.lit(0)))


def combos(normal: Column) -> Column:
    """Distinct key combinations, written ``ctrl+z``, ascending."""
    found = F.regexp_extract_all(normal, F.lit(COMBO), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda c: F.lower(F.regexp_replace(c, f"(?iuU){JOIN}", "+")))))


def latin_terms(normal: Column) -> Column:
    """Latin words in order, key combinations left out."""
    return F.regexp_extract_all(F.regexp_replace(normal, COMBO, " "), F.lit(LATIN_TERM), F.lit(0))


def count_cjk(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CJK}]"))


def quote(text: str) -> str:
    """A Java pattern that matches just this text."""
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|&#~ " else c for c in text)


#: Between two characters of :data:`LATIN`, before a term and behind it: there no term begins or ends.
INSIDE_BEFORE, INSIDE_AFTER = f"(?<![{LATIN}](?=[{LATIN}]))", f"(?!(?<=[{LATIN}])[{LATIN}])"


def term_pattern(spellings: Iterable[str]) -> str:
    """Any of the spellings, the longest that fits, in any case; a run of Latin letters and digits is never cut."""
    either_of = "|".join(map(quote, sorted(spellings, key=lambda s: -len(s))))
    return f"(?iu){INSIDE_BEFORE}(?:{either_of}){INSIDE_AFTER}"


def term_pattern_of(spellings: Column) -> Column:
    """:func:`term_pattern` of an array column."""
    by_size = F.array_sort(spellings, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(by_size, lambda s: F.regexp_replace(s, r"([\\.\[\](){}<>*+\-=!?^$|&#~ ])", r"\\$1"))
    return F.concat(F.lit(f"(?iu){INSIDE_BEFORE}(?:"), F.array_join(quoted, "|"), F.lit(f"){INSIDE_AFTER}"))


def has_word(word: Column, text: Column) -> Column:
    """Whether a word (column) stands in a text by itself, in any case."""
    escaped = F.regexp_replace(word, r"([\\.\[\]{}()*+\-?^$|#])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(f"(?iu)(?<![{LATIN}])"), escaped, F.lit(f"(?![{LATIN}])")))
