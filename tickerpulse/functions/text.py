"""Text Column functions.

All are JVM expressions (regexp_*, transform/filter lambdas), no Python UDF.
Java regex classes are ASCII unless ``(?U)`` is given, so every pattern that
uses \\w, \\s or \\b carries the flag to match Unicode-aware semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Placeholder spellings of deleted content (compared after trim + lower).
PLACEHOLDERS = ("", "[deleted]", "[removed]", "nan")

# Minimum stripped text length; texts must be strictly longer.
MIN_TEXT_LENGTH = 10

# Common English words never taken as tickers when they appear as ALL-CAPS words
# (cashtags are not filtered by this list).
ENGLISH_WORDS = frozenset("""
A AM AN AND ARE AS AT BE BY FOR FROM HAS HE IN IS IT ITS OF ON THAT THE TO WAS WILL WITH YOU YOUR
ALL BUT CAN HAD HER HIM HOW MAN NEW NOW OLD SEE TWO WHO BOY DID GET LET MAY PUT SAY SHE TOO USE WAY
WE WELL WERE WHAT WHEN WHERE WHICH WHO WHY WOULD YEAR YES YET GOOD GREAT BEST BETTER MUCH MORE MOST
VERY AFTER AGAIN AGAINST ALSO ALWAYS ANOTHER ANY AROUND BACK BEFORE BEING BETWEEN BOTH CAME COME
COULD DOWN EACH EVEN EVERY FIND FIRST GIVE GO GOING GOOD GOT HAVE HERE HOME INTO JUST KEEP KNOW LAST
LEFT LIFE LIKE LITTLE LONG LOOK MADE MAKE MANY MIGHT MOVE MUCH MUST NEED NEVER NEXT NIGHT NO NOT
ONLY OTHER OUR OUT OVER OWN PLACE RIGHT SAID SAME SHOULD SINCE SO SOME STILL SUCH TAKE THAN THEM
THERE THESE THEY THING THINK THIS THOSE THROUGH TIME UNDER UP WANT WATER WELL WENT WHAT WHEN WHERE
WHILE WORK WORLD WRITE YEAR YOUNG YOUR TAX BEAT EA LE
""".split())

# Built-in English stop-word list used for stop-word removal.
STOPWORDS = frozenset("""
the a an and or but in on at to for of with by from as is are was were be been being have has had
do does did will would could should may might must can this that these those i you he she it we
they me my myself our ours ourselves your yours yourself yourselves him his himself her hers
herself its itself they them their theirs themselves what which who whom this that these those am
is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with through during before after above below up down in out
on off over under again further then once
""".split())

# Candidate patterns.
CASHTAG_RE = r"\$([A-Za-z]{1,5}(?:[.-][A-Za-z]{1,2})?)\b"
CAPS_WORD_RE = r"(?=[A-Z])\b([A-Z]{2,5}(?:[.-][A-Z]{1,2})?)\b"
# Any ticker-shaped token: optional cashtag, 2-5 letters, optional class suffix.
# (What rules a place out cheaply comes first, and letters are taken possessively: no shorter run can end a word.)
TICKER_SHAPE_RE = r"(?=[$A-Za-z])(?<![A-Za-z0-9_])(?<!\w)(?:\$[A-Za-z]{1,5}+|[A-Za-z]{2,5}+)(?:[.-][A-Za-z]{1,2}+)?(?!\w)"

_U = "(?U)"
_MARK_OPEN, _MARK_CLOSE = "\u0001", "\u0002"


# ------------------------------------------------------------- predicates

# Characters Python's str.strip() removes (Unicode whitespace).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Strip all Unicode whitespace at both ends (``trim`` only cuts spaces)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_placeholder(c) -> Column:
    """NULL, or trimmed lower-case value in {'', '[deleted]', '[removed]', 'nan'}."""
    return F.coalesce(F.lower(strip_ws(c)).isin(*PLACEHOLDERS), F.lit(True))


def blank_placeholder(c) -> Column:
    """Placeholder -> '', otherwise the stripped text.

    (Each helper references its input as few times as possible: filters are
    pushed through projections by substitution, so a reference count > 1
    multiplies down a chain of steps.)
    """
    s = strip_ws(c)
    return F.when(F.coalesce(F.lower(s).isin(*PLACEHOLDERS), F.lit(True)), F.lit("")).otherwise(s)


def is_valid_text(c, min_len: int = MIN_TEXT_LENGTH) -> Column:
    """P5: not NULL, stripped text not '[deleted]'/'[removed]'/'' and longer than ``min_len``."""
    s = strip_ws(c)
    return F.coalesce(~s.isin("[deleted]", "[removed]", "") & (F.length(s) > min_len), F.lit(False))


# --------------------------------------------------------------- builders

def merge_title_body(type_col, title, body) -> Column:
    """Posts get 'title. body' (or whichever part is non-empty); comments their body."""
    t = strip_ws(title)
    b = strip_ws(body)
    is_post = col(type_col) == "post"
    # concat_ws skips NULL parts: "title. body", "title", "body" or "".
    return F.concat_ws(". ",
                       F.when(is_post & ~F.coalesce(t.isin("", "nan"), F.lit(True)), t),
                       F.when(~is_post | ~F.coalesce(b.isin("", "nan"), F.lit(True)), F.coalesce(b, F.lit(""))))


def cashtags(c) -> Column:
    """Upper-cased cashtag symbols in order of appearance (without '$')."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(_U + CASHTAG_RE), 1),
                       lambda x: F.upper(x))


def caps_words(c) -> Column:
    """ALL-CAPS 2-5 letter words (optional class suffix), English words removed."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(_U + CAPS_WORD_RE), 1)
    return F.filter(found, lambda x: ~x.isin(*sorted(ENGLISH_WORDS)))


def class_variants(sym) -> Column:
    """Lookup order for a symbol: as is, then '.'->'-', then '-'->'.'."""
    s = col(sym)
    return F.array_distinct(F.filter(F.array(
        s,
        F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.", "-")),
        F.when(F.instr(s, "-") > 0, F.regexp_replace(s, "-", "."))), lambda x: x.isNotNull()))


def text_length(c) -> Column:
    """Length in code points."""
    return F.length(F.coalesce(col(c), F.lit("")))


# Regex class of the same whitespace set (for splitting into words).
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def split_words(c) -> Column:
    """Whitespace-separated words (empty strings removed)."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), WS_CLASS + "+"), lambda x: x != "")


def word_count(c) -> Column:
    """Number of whitespace-separated words."""
    return F.size(split_words(c))


# ---------------------------------------------------------- normalisation

def normalize_text(c, tickers=None, compat: bool = False) -> Column:
    """Text for a sentiment model.

    Markdown links become their text, URLs are removed, protected ticker
    tokens keep their (upper-cased) form, all other characters outside
    [A-Za-z0-9_] split words, words are lower-cased and joined by one space.

    Protected tokens: with ``compat=True`` every ticker-shaped token
    (cashtag or any 2-5 letter word, as the reference's regex does); otherwise
    cashtags plus words whose upper form is in the array column ``tickers``
    (the row's detected symbols).
    """
    return _joined(_marked_tokens(c), tickers, compat)


def normalized_views(c, tickers=None) -> Column:
    """X6 in both modes: struct<normalized, normalized_compat>, from one pass over the text."""
    both = F.transform(F.array(_marked_tokens(c)), lambda toks: F.struct(
        _joined(toks, tickers, False).alias("normalized"), _joined(toks, tickers, True).alias("normalized_compat")))
    return F.get(both, F.lit(0))


def _marked_tokens(c) -> Column:
    """The words of a text without links; a ticker-shaped token has its marks on."""
    s = F.coalesce(col(c), F.lit(""))
    linkless = F.regexp_replace(F.regexp_replace(s, r"\[([^\]]+)\]\(http[^)\s]*\)", "$1"), r"http\S+", " ")
    s = F.when(F.contains(s, F.lit("http")), linkless).otherwise(s)
    s = F.regexp_replace(s, _U + TICKER_SHAPE_RE, _MARK_OPEN + "$0" + _MARK_CLOSE)
    return F.regexp_extract_all(s, F.lit(f"{_MARK_OPEN}[^{_MARK_CLOSE}]*{_MARK_CLOSE}|[A-Za-z0-9_]+"), 0)


def _joined(toks, tickers, compat: bool) -> Column:
    def fix(t):
        inner = F.replace(F.replace(t, F.lit(_MARK_OPEN), F.lit("")), F.lit(_MARK_CLOSE), F.lit(""))
        marked = F.startswith(t, F.lit(_MARK_OPEN))
        low = F.lower(inner)
        plain = F.when(low.rlike("[^a-z0-9_]"), F.trim(F.regexp_replace(low, "[^a-z0-9_]+", " "))).otherwise(low)
        if compat:
            fixed = F.upper(inner)
        else:
            keep = F.startswith(inner, F.lit("$"))
            if tickers is not None:
                keep = keep | ((F.size(col(tickers)) > 0) & F.array_contains(col(tickers), F.upper(inner)))
            fixed = F.when(keep, F.upper(inner)).otherwise(plain)
        return F.when(marked, fixed).otherwise(F.lower(t))  # an unmarked token is of [A-Za-z0-9_] only

    return F.array_join(F.filter(F.transform(toks, fix), lambda x: x != ""), " ")


def remove_stopwords(c, tickers=None, compat: bool = False) -> Column:
    """Drop words whose cleaned lower form is a stop-word, unless the word is a ticker.

    Words are split on whitespace; the cleaned form drops non-word characters;
    words that clean to '' are dropped. Tickers: every ticker-shaped token of
    the text with ``compat=True``, else the array column ``tickers``.
    """
    s = F.coalesce(col(c), F.lit(""))
    if compat:
        tick = F.transform(F.regexp_extract_all(s, F.lit(_U + TICKER_SHAPE_RE), 0), lambda x: F.upper(x))
    else:
        tick = col(tickers) if tickers is not None else F.array().cast("array<string>")
    stop = sorted(STOPWORDS)
    # all words are cleaned in one pass: white space stays, so the two lists run in step
    clean = F.split(F.lower(F.regexp_replace(s, _U + rf"[^\w{WS_CLASS[1:-1]}]+", "")), WS_CLASS)

    def kept(w, own):
        return F.when((own != "") & (~own.isin(*stop) | F.array_contains(tick, F.upper(w))), w)

    return F.array_join(F.zip_with(F.split(s, WS_CLASS), clean, kept), " ")  # array_join leaves nulls out


# ------------------------------------------------------------------ lists

def parse_ticker_list(c) -> Column:
    """R1: "['AAA', 'BB']" or "AAA,BB" -> array of trimmed non-blank symbols."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\[\]'\"]", "")
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def ticker_csv(c) -> Column:
    """List -> comma-separated string (text sinks only)."""
    return F.array_join(F.coalesce(col(c), F.array().cast("array<string>")), ",")
