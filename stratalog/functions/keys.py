"""Keys as bytes: prefix ranges, and key patterns translated to the regular expressions that Spark runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidPattern, KeyIsEmpty


def as_key(key: bytes | str) -> bytes:
    raw = key.encode() if isinstance(key, str) else key
    if not raw:
        raise KeyIsEmpty("a key needs at least one byte")
    return bytes(raw)


def as_bytes(bound: bytes | str | None) -> bytes:
    """A bound; None is the empty key, which sorts before all others."""
    return b"" if bound is None else bound.encode() if isinstance(bound, str) else bytes(bound)


def prefix_successor(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with this prefix, or None where there is none (all bytes 0xFF)."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def bound(column: Column, value: bytes, like_string: bool = False) -> Column:
    """A literal that compares with the key column: text where keys are stored as text."""
    return F.lit(value.decode(errors="surrogateescape") if like_string else value)


def has_prefix(key: Column, prefix: bytes, like_string: bool = False) -> Column:
    """The prefix as a range of keys, which Parquet's statistics can prune (``startswith`` on binary is not pushed down).

    A text column holds UTF-8 and sorts by its bytes, but an upper bound need not be UTF-8, so there the engine's own
    ``startswith`` is used, which is pushed down for text.
    """
    if not prefix:
        return F.lit(True)
    if like_string:
        return key.startswith(prefix.decode())
    upper = prefix_successor(prefix)
    low = key >= F.lit(prefix)
    return low if upper is None else low & (key < F.lit(upper))


def translate_pattern(pattern: str) -> str:
    """The same pattern for Java's engine.

    Patterns are unanchored and follow a linear-time dialect: no look-around, no back references, no possessive or
    atomic groups. ``.`` excludes only the line feed, ``$`` outside classes is the end of the key (unless (?m) is set),
    and named groups are written (?P<name>...).
    """
    out, i, in_class, many = [], 0, False, "m" in _leading_flags(pattern)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise InvalidPattern("trailing backslash")
            nxt = pattern[i + 1]
            if not in_class and (nxt.isdigit() and nxt != "0" or nxt in "kZGX"):
                raise InvalidPattern(f"\\{nxt} is not allowed")
            if nxt == "z":
                out.append("\\z")
            elif nxt == "C":
                raise InvalidPattern("single bytes cannot be matched")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[" and pattern.startswith("[:", i) and ":]" in pattern[i + 2 :]:
                end = pattern.index(":]", i + 2)
                out.append(_posix(pattern[i + 2 : end]))
                i = end + 2
                continue
            # Java gives these a meaning inside classes that the dialect does not.
            out.append("\\" + c if c == "[" or pattern.startswith("&&", i) else c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if i < len(pattern) and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < len(pattern) and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if c == "(" and pattern.startswith("(?", i):
            if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>", "(?#"), i):
                raise InvalidPattern("look-around and atomic groups are not allowed")
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
        if c in "*+?}" and pattern.startswith("+", i + 1):
            raise InvalidPattern("possessive repetition is not allowed")
        out.append("\\z" if c == "$" and not many else c)
        i += 1
    if in_class:
        raise InvalidPattern("a class is not closed")
    # (?d): only the line feed ends lines.
    return "(?d)" + "".join(out)


def _leading_flags(pattern: str) -> str:
    return pattern[2 : pattern.index(")")] if pattern.startswith("(?") and ")" in pattern and pattern[2:3].isalpha() and pattern[2] != "P" else ""


def _posix(name: str) -> str:
    """Bracketed class names are Java's POSIX classes, negated ones too."""
    negated, word = name.startswith("^"), name.lstrip("^")
    if word == "word":
        return "\\W" if negated else "\\w"
    names = ("alnum", "alpha", "ascii", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper", "xdigit")
    if word not in names:
        raise InvalidPattern(f"unknown class {name}")
    return ("\\P{" if negated else "\\p{") + {"ascii": "ASCII", "xdigit": "XDigit"}.get(word, word.capitalize()) + "}"


def matches(key: Column, pattern: str | None) -> Column:
    """Whether the key contains a match; no pattern matches all. Keys are read as UTF-8."""
    if not pattern:
        return F.lit(True)
    return key.cast("string").rlike(translate_pattern(pattern))


def check_pattern(spark, pattern: str | None) -> None:
    """Raise for patterns that do not compile."""
    if pattern:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(translate_pattern(pattern))
        except InvalidPattern:
            raise
        except Exception as e:
            raise InvalidPattern(str(e).splitlines()[0]) from e
