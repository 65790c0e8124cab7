"""Java lexer as one regular expression: comments, literals, numbers, identifiers and operators in one pass.

Comments and literals decide their own ends in one left-to-right scan, so one ordered alternation covers both
comment removal and tokenizing. Quantified groups are possessive: literals of any length need no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords kept as they are.
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null var record sealed permits yield"
).split()
#: Operators of several characters in the order they are tried, then single characters.
OPERATORS = ">>>= <<= >>= ... >>> -> :: ++ -- == != <= >= && || += -= *= /= %= &= |= ^= << >>".split()
SINGLES = "{}()[];,.?:+-*/%<>=!&|^~@"


def _escape(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


#: What counts as a comment, a literal, a number and an identifier.
COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
TEXT_BLOCK = r'"""(?:[^"]++|"(?!""))*+(?:""")?'
STRING = r'"(?:[^"\\]++|\\(?s:.))*+(?:"|\\)?'
CHARACTER = r"'(?:[^'\\]++|\\(?s:.))*+(?:'|\\)?"
NUMBER = (
    r"0[xX][0-9a-fA-F_]++(?:\.[0-9a-fA-F_]*+)?(?:[pP][+-]?[0-9_]++)?[fFdDlL]?|0[bB][01_]++[lL]?"
    r"|\p{Nd}[\p{Nd}_]*+(?:\.(?!\.)[\p{Nd}_]*+)?(?:[eE][+-]?[\p{Nd}_]++)?[fFdDlL]?|\.(?=\p{Nd})[\p{Nd}_]++(?:[eE][+-]?[\p{Nd}_]++)?[fFdD]?"
)
IDENTIFIER = r"[\p{L}_$][\p{L}\p{N}_$]*+"
TOKEN = "|".join([COMMENT, TEXT_BLOCK, STRING, CHARACTER, NUMBER, IDENTIFIER, *map(_escape, OPERATORS), f"[{_escape(SINGLES)}]"])


def raw_tokens(code: Column) -> Column:
    """All matches in order, comments included."""
    return F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(f"({TOKEN})"), F.lit(0))


def normalise(token: Column) -> Column:
    """STR_LIT, CHAR_LIT, NUM_LIT, ID, or the keyword or operator itself; null for a comment."""
    first = F.substring(token, 1, 1)
    keyword = token.isin(*KEYWORDS)
    return (
        F.when(token.startswith("//") | token.startswith("/*"), F.lit(None).cast("string"))
        .when(first == '"', "STR_LIT")
        .when(first == "'", "CHAR_LIT")
        .when(first.rlike(r"^\p{Nd}$") | token.rlike(r"^\.\p{Nd}"), "NUM_LIT")
        .when(first.rlike(r"^[\p{L}_$]$"), F.when(keyword, token).otherwise("ID"))
        .otherwise(token)
    )


def java_tokens(code: Column) -> Column:
    """Normalised tokens of a Java text, in order; null is an empty text."""
    return F.array_compact(F.transform(raw_tokens(code), normalise))


def strip_comments(code: Column) -> Column:
    """The text with every comment character but newlines turned into a space; literals are left alone."""
    # only matched comments are blanked: split the text into matches and gaps by one extraction
    pieces = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(f"({COMMENT}|{TEXT_BLOCK}|{STRING}|{CHARACTER}|[^/\"']++|(?s:.))"), F.lit(0))
    blank = lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)
    return F.array_join(F.transform(pieces, blank), "")
