"""Column functions over code, log and post text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and marks whose matches the results are defined by.
JAVA_VERSION = r"(?i)((javac?)|(jdk)) ?(v(ersion)?)? ?1.([1-9])(.[\d_]+)?"  # group 6
JAVA_LANG_EXCEPTION = r"java\.lang\.([a-zA-Z]+(Exception|Bounds|Error))"  # group 1
JAVA_IO_EXCEPTION = r"java\.io\.([a-zA-Z]+(Exception|Error))"  # group 1
CAPITALISED = r"\b([A-Z]\w+)\b"  # group 1
EXIT_LINE = r"\A\nProcess finished with exit code \d+\n\z"
SCRIPT_OPEN, SCRIPT_CLOSE = "<script>", "</script>"

# A word is a run of letters, digits and underscores in any script. The two runs together tile the
# text, which is what splitting at every word boundary gives.
WORD_RUN = r"[\p{L}\p{Nd}_]+"
GAP_RUN = r"[^\p{L}\p{Nd}_]+"

_IMPORT = r"import\s+([\w.]*\w);"
# Neither branch nests a group under a quantifier, so a long comment needs no deep recursion.
_COMMENT = r"(//.*?\n)|(/\*[^\r\u0085\u2028\u2029]*?\*/)"
# Blank, for trimming, is every character up to and including the space.
_BLANKS = "".join(chr(c) for c in range(0x21))
_NOT_BLANK = r"[^\x00-\x20]"


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order. The array may hold empty strings at its ends."""
    return F.split(F.lower(text), GAP_RUN)


def distinct_words(text: Column) -> Column:
    """Lower-cased distinct words of a text, without empty strings."""
    return F.array_remove(F.array_distinct(words(text)), "")


def boundary_terms(text: Column) -> Column:
    """Lower-cased pieces between word boundaries: words, and the gaps between them, in order."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_RUN}|{GAP_RUN})"), 1)
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(_NOT_BLANK)


def trim_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def line_at(text: Column, index: Column) -> Column:
    """The line at a 0-based index, or null past the last line. Trailing empty lines do not count."""
    kept = F.rtrim(text, F.lit("\n"))
    only_newlines = (text != "") & (kept == "")
    return F.when(~only_newlines, F.get(F.split(kept, "\n"), index))


def strip_comments(text: Column) -> Column:
    """Remove `//` comments with their newline, and block comments.

    A line comment that ends in CR LF stays, as does a block that holds a carriage return.
    """
    return F.regexp_replace(text, _COMMENT, "")


def extract_imports(text: Column) -> Column:
    """Distinct dotted names of import statements, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_IMPORT), 1))


def find_patterns(texts: Column, pattern: str, group: int) -> Column:
    """All matches of one group over an array of texts, in order, duplicates kept."""
    return F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), group)))


def first_line(texts: Column) -> Column:
    """First line of the first text without colons; null when there is no text.

    Where the first text is only newlines, this gives the empty string.
    """
    return first_line_of(F.get(texts, 0))


def first_line_of(text: Column) -> Column:
    return F.replace(F.substring_index(text, "\n", 1), F.lit(":"), F.lit(""))


def string_hash(text: Column) -> Column:
    """Signed 32-bit hash h = 31 h + c over UTF-16 code units."""
    units = F.flatten(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(
                F.ascii(c) > 0xFFFF,
                F.array(
                    F.lit(0xD800) + F.shiftright(F.ascii(c) - 0x10000, 10),
                    F.lit(0xDC00) + (F.ascii(c) - 0x10000).bitwiseAND(0x3FF),
                ),
            ).otherwise(F.array(F.ascii(c))),
        )
    )
    span = 1 << 32
    unsigned = F.aggregate(
        units,
        F.lit(0).cast("long"),
        lambda h, c: F.pmod(h * 31 + c.cast("long"), F.lit(span).cast("long")),
    )
    value = F.when(unsigned >= span // 2, unsigned - span).otherwise(unsigned)
    return F.when(text == "", F.lit(0)).otherwise(value.cast("int"))


def hash_tags(tags: Column) -> Column:
    """Hashes of the tags of a space-separated list. An empty list hashes to `[0]`."""
    return F.transform(F.split(tags, " "), string_hash)


def strip_script_marks(text: Column) -> Column:
    """Remove script marks until none is left, also those that a removal puts together.

    Marks cannot overlap, so the order of removal does not matter. Each further pass uses up one
    `>` at least, which bounds the passes; texts that are clean after the first pass take no more.
    """

    def once(value: Column) -> Column:
        opened = F.replace(value, F.lit(SCRIPT_OPEN), F.lit(""))
        return F.replace(opened, F.lit(SCRIPT_CLOSE), F.lit(""))

    def marked(value: Column) -> Column:
        return F.contains(value, F.lit(SCRIPT_OPEN)) | F.contains(value, F.lit(SCRIPT_CLOSE))

    first = once(text)
    passes = F.length(first) - F.length(F.replace(first, F.lit(">"), F.lit("")))
    rest = F.aggregate(
        F.sequence(F.lit(0), passes),
        first,
        lambda value, _: F.when(marked(value), once(value)).otherwise(value),
    )
    return F.when(marked(first), rest).otherwise(first)


def clean_parameter(value: Column) -> Column:
    """A request value as it is sent: braces deleted, blanks trimmed."""
    return trim_blanks(F.regexp_replace(value, "[{}]", ""))


def bracketed(tags: Column) -> Column:
    """`[a] [b]` for an array of tags."""
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ")


def tag_display(tags: Column) -> Column:
    """`[a] [b] ` with a blank after every tag; a null array shows as the empty string."""
    shown = F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("] ")))
    return F.coalesce(F.array_join(shown, ""), F.lit(""))


def excerpt_cut(
    body: Column, open_mark: str, close_mark: str, cutoff: int = 300, tolerance: int = 100
) -> Column:
    """Length at which to cut a body so that no marked block is torn.

    The k-th opening mark (0-based) pairs with the k-th closing mark; when the E closing marks run
    out, the next block has none (-1), and then the closing marks start over. Blocks are tried from
    the last to the first; in a block the first rule that holds decides:
    closing mark within the tolerance -> cut there; opening mark within it -> cut just before;
    block spans the cutoff -> cut just before it opens. No block decides -> the cutoff.

    A mark at `reach` or beyond cannot decide by its own position, so only marks before that are
    located. Blocks further out can still decide through a closing mark that came round again: for
    each near closing mark, that is the last block paired with it. Marks are counted over the whole
    body. Positions count characters.
    """
    reach = cutoff + tolerance

    def offsets(mark: str) -> Column:
        # at most `reach` marks fit before `reach`
        lengths = F.transform(
            F.slice(F.split(body, f"\\Q{mark}\\E", -1), 1, reach),
            lambda part: F.length(part) + len(mark),
        )
        ends = F.aggregate(
            lengths,
            F.array(F.lit(0)),
            lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)),
        )
        starts = F.transform(F.slice(ends, 2, reach), lambda end: end - len(mark))
        return F.filter(starts, lambda at: (at < reach) & (at <= F.length(body) - len(mark)))

    def count(mark: str) -> Column:
        gap = F.length(body) - F.length(F.replace(body, F.lit(mark), F.lit("")))
        return (gap / len(mark)).cast("int")

    def near(at: Column) -> Column:
        return F.abs(at - cutoff) < tolerance

    opens, closes = offsets(open_mark), offsets(close_mark)
    n_open, n_close = count(open_mark), count(close_mark)
    cycle = n_close + 1

    def close_of(k: Column) -> Column:
        slot = F.pmod(k, cycle)
        # a closing mark that was not located lies at `reach` or beyond
        return F.when(slot == n_close, -1).otherwise(F.coalesce(F.get(closes, slot), F.lit(reach)))

    def rule(k: Column, precedence: int, cut: Column) -> Column:
        return F.struct(k.alias("k"), F.lit(precedence).alias("precedence"), cut.alias("cut"))

    def by_open(at: Column, k: Column) -> Column:
        spans = (at < cutoff) & (close_of(k) > cutoff)
        return F.when(near(at) | spans, rule(k, 0, at - 1))

    def by_close(at: Column, slot: Column) -> Column:
        last = n_open - 1 - F.pmod(n_open - 1 - slot, cycle)
        return F.when(near(at) & (slot < n_open), rule(last, 1, at))

    deciding = F.concat(F.transform(opens, by_open), F.transform(closes, by_close))
    best = F.array_max(F.filter(deciding, lambda rule: rule.isNotNull()))
    return F.coalesce(best["cut"], F.lit(cutoff))
