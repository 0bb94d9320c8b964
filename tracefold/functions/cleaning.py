"""Document clean-up: HTML to text, boilerplate, statement and label lines."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import fixed
from .entities import decode_entities
from .fixed import WS, WORD
from .strings import any_contains, any_endswith, let, lstrip_chars, split_sentences, strip, words


LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def html_to_text(html: Column, profile: str = "plain") -> Column:
    """Visible text of a page.

    'plain' drops scripts and styles only; 'article' also drops navigation,
    footers, side bars, reference lists and [n] markers, and decodes entities.
    """
    t = html
    blocks = ["script", "style"] + (["nav", "footer"] if profile == "article" else [])
    for tag in blocks:
        t = F.regexp_replace(t, f"(?s)<{tag}[^>]*>.*?</{tag}>", "")
    if profile == "article":
        for cls in ("sidebar", "reflist"):
            t = F.regexp_replace(t, f'(?s)<div[^>]*class="[^"]*{cls}[^"]*"[^>]*>.*?</div>', "")
        t = F.regexp_replace(t, r"\[[0-9]+\]", "")
    t = F.regexp_replace(t, f"(?i)</?({fixed.BLOCK_TAGS})[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    if profile == "article":
        t = decode_entities(t)
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, f"\n[ \t]*\n(?:\n|{WS})*", "\n\n")
    return strip(t)


def strip_boilerplate(text: Column, free_text: bool = True) -> Column:
    """Keep body lines: 20 or more characters and no navigation phrase.

    Blank lines survive once the body has begun, so paragraphs stay apart.
    """
    phrases = fixed.BOILERPLATE_PHRASES + (fixed.BOILERPLATE_FREE_TEXT if free_text else [])
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda s: (s == "") | ((F.length(s) >= 20)
                                                  & ~any_contains(F.lower(s), phrases)))
    return F.regexp_replace(F.array_join(kept, "\n"), "^\n+", "")


def detect_format(text: Column, source: Column) -> Column:
    s = F.lower(source)
    return (F.when(any_endswith(s, fixed.MARKDOWN_SUFFIXES), "markdown")
            .when(any_endswith(s, fixed.CODE_SUFFIXES), "code")
            .when(F.regexp_replace(text, f"^{WS}+", "").startswith("#")
                  & F.contains(text, F.lit("\n## ")), "markdown")
            .when(F.contains(text, F.lit("\ndef ")) | F.contains(text, F.lit("\nclass ")), "code")
            .otherwise("text"))


def _first_per_text(lines: DataFrame, key: list[str], folded: Column) -> DataFrame:
    order = W.partitionBy(*key, folded).orderBy("pos")
    return lines.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def clean_statement_lines(df: DataFrame, key: list[str], text: str = "text",
                          rejects=tuple(fixed.STATEMENT_REJECTS), max_chars: int = None) -> DataFrame:
    """(key, pos, line): bulleted output lines cleaned and deduplicated per text.

    Lines longer than ``max_chars`` are left out; None keeps all.
    """
    lines = df.select(*key, F.posexplode(F.split(text, LINE_END)).alias("pos", "line"))
    lines = lines.withColumn("line", strip(lstrip_chars(strip(F.col("line")),
                                                        fixed.BULLET_CHARS)))
    low = F.lower("line")
    lines = lines.filter((F.col("line") != "") & (F.upper("line") != "NONE")
                         & ~any_contains(low, rejects))
    if max_chars is not None:
        lines = lines.filter(F.length("line") <= max_chars)
    return _first_per_text(lines, key, low)


def clean_labels(df: DataFrame, key: list[str], text: str = "text",
                 max_chars: int = None) -> DataFrame:
    """(key, pos, label): lower-case labels from free lines, deduplicated per text.

    Labels longer than ``max_chars`` are left out; None keeps all.
    """
    lines = df.select(*key, F.posexplode(F.split(text, LINE_END)).alias("lno", "line"))
    line = lstrip_chars(strip(F.col("line")), fixed.BULLET_CHARS)
    after = F.when(F.contains(line, F.lit(":")), F.regexp_replace(line, "^[^:]*:", "")) \
        .otherwise(line)
    parts = lines.select(*key, "lno", F.posexplode(F.split(F.lower(strip(after)), ","))
                         .alias("pno", "label"))
    label = F.regexp_replace(strip(F.col("label")), "^[\"'`]+|[\"'`]+$", "")
    label = strip(F.regexp_replace(label, r"[^a-z0-9_ -]", ""))
    parts = (parts.withColumn("label", label)
             .withColumn("pos", F.struct("lno", "pno"))
             .filter(F.col("label").rlike("^[a-z0-9][a-z0-9_ -]*$")
                     & ~any_contains(F.col("label"), fixed.LABEL_REJECTS)))
    if max_chars is not None:
        parts = parts.filter(F.length("label") <= max_chars)
    return _first_per_text(parts.select(*key, "pos", "label"), key, F.col("label"))


def _without_markup(c: Column) -> Column:
    return F.regexp_replace(c, rf"\*\*|`|#+{WS}*", "")


def plain_sentences(text: Column) -> Column:
    """Sentences without emphasis marks, longer than ten characters."""
    return F.filter(F.transform(split_sentences(_without_markup(text)), strip),
                    lambda s: F.length(s) > 10)


# WORD and WS spell out what \w and \s mean for Unicode text
_REST = "[" + WORD[1:-1] + WS[1:-1] + r"\-]"
#: Characters of a subject at most.
_SUBJECT = 41
_CLAIM = (rf"({WORD}{_REST}{{1,{_SUBJECT - 1}}}?){WS}+({fixed.EXTRACT_VERBS}){WS}+"
          rf"({WORD}{_REST}+)")
_HEDGED = "(?iU)(?:" + "|".join(p for p, _ in fixed.HEDGES) + ")"


def _unhedged(s: Column) -> Column:
    """Hedged verbs rewritten; sentences without any are passed over in one search."""
    plain = s
    for pattern, verb in fixed.HEDGES:
        plain = F.regexp_replace(plain, "(?iU)" + pattern, verb)
    return F.when(s.rlike(_HEDGED), plain).otherwise(s)


def _claim(s: Column) -> Column:
    """The claim of a sentence, else null.

    Every step is worked out once, inside the array of sentences, where no filter can copy it.
    The search begins no further ahead of the first verb than a subject is long.
    """
    s = _unhedged(F.regexp_replace(strip(s), r"\.+$", ""))

    def from_verb(s):
        head = F.regexp_extract(s, rf"(?is)^(.*?){WS}(?:{fixed.EXTRACT_VERBS}){WS}", 1)
        return let(head, lambda h: F.when(h != "", F.regexp_extract(F.substring(
            s, F.greatest(F.lit(1), F.length(F.regexp_replace(h, rf"(?<!{WS}){WS}+$", "")) - (_SUBJECT - 1)),
            F.length(s)), "(?i)" + _CLAIM, 0)))

    def parts(m):
        # one match per sentence: all three groups come from the same first match
        subject, verb, obj = (F.regexp_extract(m, f"(?i)^{_CLAIM}$", k) for k in (1, 2, 3))
        obj = F.split(obj, r"(?U),|\band\b|\bbut\b|\bnot\b|\bwhich\b|\bthat\b|\bwhen\b", 2)[0]
        last = let(words(subject), lambda w: F.when(F.size(w) > 4, F.slice(w, F.size(w) - 3, 4)).otherwise(w))
        return F.when(m != "", let(F.struct(last.alias("subject"), F.lower(verb).alias("verb"),
                                            strip(obj).alias("obj")), stated))

    def stated(c):
        joined = F.array_join(c["subject"], " ")
        noise = F.lower(joined).isin(fixed.NOISE_SUBJECTS) | F.lower(F.get(c["subject"], F.lit(0))).isin(fixed.NOISE_STARTS)
        clean = _without_markup(F.concat_ws(" ", joined, c["verb"], c["obj"]))
        clean = F.regexp_replace(clean, rf"^{WS}*[-*]{WS}+", "")
        clean = strip(F.regexp_replace(clean, rf"^{WS}*[0-9]+[.)]{WS}+", ""))
        return F.when(~noise & (F.length(c["obj"]) > 2), clean)
    return let(s, lambda s: let(from_verb(s), parts))


def extract_statements(df: DataFrame, key: list[str], text: str = "text",
                       per_text: int = None, max_chars: int = None) -> DataFrame:
    """(key, pos, statement): 'subject verb object' claims found in prose.

    Hedged verbs are rewritten first; the subject keeps its last four words, the
    object ends at the first comma or conjunction.  ``per_text`` keeps the first
    statements of a text, ``max_chars`` those shorter than it; None keeps all.
    """
    claims = F.filter(F.transform(split_sentences(F.col(text)), lambda s, i: F.struct(
        i.alias("pos"), _claim(s).alias("statement"))), lambda c: F.length(c["statement"]) > 10)
    found = df.select(*key, F.inline(claims))
    if max_chars is not None:
        found = found.filter(F.length("statement") < max_chars)
    once = _first_per_text(found.select(*key, "pos", "statement"), key, F.col("statement"))
    nth = F.row_number().over(W.partitionBy(*key).orderBy("pos"))
    once = once.withColumn("nth", nth)
    return once if per_text is None else once.filter(F.col("nth") <= per_text)
