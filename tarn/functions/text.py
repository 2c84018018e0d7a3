"""Text functions as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: word lists, patterns and limits that results depend on.

STOPWORDS = sorted(
    set(
        """
    yang dan atau di ke dari pada untuk dengan ini itu tersebut adalah ialah merupakan
    akan sudah telah belum masih sedang dapat bisa boleh harus perlu mau ingin juga saja
    pun lah kah tah nya ada tidak bukan jangan apa apakah siapa mana manakah kapan dimana
    bagaimana mengapa kenapa berapa berapakah kah sebutkan jelaskan tolong mohon coba
    saya aku kami kita anda kamu dia mereka beliau ia
    oleh sebagai secara agar supaya karena sebab jika jikalau kalau bila apabila maka
    namun tetapi tapi serta lalu kemudian setelah sebelum sesudah saat ketika selama
    hingga sampai antara dalam luar atas bawah tentang terhadap bagi tanpa via per
    para sang si se suatu sebuah seorang setiap tiap semua seluruh segala beberapa banyak
    lebih kurang sangat paling amat begitu demikian sini situ sana
    hal cara yaitu yakni bahwa adapun ataupun maupun dll dsb dst
    mengenai terkait berikut seperti misalnya contohnya
    the a an and or of to in on at for with from by as is are was were be been being
    this that these those it its what which who whom whose when where why how
    do does did done can could should would will shall may might must
    i you he she we they me him her us them my your our their
    about into over under than then there here also only just not no yes
    please tell show give list explain
    kaitan keterkaitan hubungan hubungannya perbedaan beda bedanya perbandingan persamaan
    pengertian definisi maksud dimaksud arti artinya makna penjelasan uraian uraikan
    contoh contohnya misal misalnya gambaran seputar dijelaskan disebut gimana gmn bgmn
    knp yg dgn utk dr tdk sih dong deh ya
    relation relationship relations difference differences between meaning definition
    define describe example examples mean means
    """.split()
    )
)
COMPOUND = r"[\p{L}\p{N}_]+(?:[-./,][\p{L}\p{N}_]+)*"
NOMINAL = r"^[a-z]{0,3}[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{1,2})?$"
FOREIGN = r"[\x{0400}-\x{04ff}\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0900}-\x{097f}\x{0e00}-\x{0e7f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BINARY_MARKS = (
    r"%PDF-[0-9]|%!PS|endobj|endstream|stream\s*\n|/FlateDecode|/Filter\b|obj\s*<<"
    r"|PK\x03\x04|\x{89}PNG|GIF8[79]a|BM\x00{2}|RIFF....WEBP|OggS|\x1f\x{8b}\x08"
)
TOKENS_PER_WORD = 1.34
INDONESIAN_HINTS = [" yang ", " dan ", " adalah ", " untuk ", " dengan ", " tidak "]
ENGLISH_HINTS = [" the ", " and ", " is ", " for ", " with ", " not "]
SECRET_PATTERNS = [
    (r"(?i)(authorization\s*[:=]\s*)(bearer\s+)?[A-Za-z0-9._\-]{8,}", "$1***"),
    (r"(?i)(api[_-]?key\"?\s*[:=]\s*\"?)[A-Za-z0-9._\-]{8,}", "$1***"),
    (r"sk-[A-Za-z0-9]{10,}", "***"),
]
INJECTION_MARKERS = [
    "ignore previous instructions",
    "ignore the system prompt",
    "disregard all previous",
    "reveal your system prompt",
    "abaikan instruksi sebelumnya",
    "abaikan aturan di atas",
    "system prompt",
    "you are now",
]


def plain_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def surface_tokens(text: Column) -> Column:
    """Lower-case tokens; codes, dates and amounts are kept whole beside their parts, in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(COMPOUND), F.lit(0))
    trimmed = F.filter(F.transform(found, lambda m: F.regexp_replace(m, r"^[-./,_]+|[-./,_]+$", "")), lambda t: t != "")

    def forms(token: Column) -> Column:
        parts = F.filter(F.split(token, "[-./,]+"), lambda p: p != "")
        long_parts = F.filter(parts, lambda p: (F.length(p) >= 2) | p.rlike(r"^\p{Nd}+$"))
        joined = F.regexp_replace(token, r"[.,]([0-9]{3})(?=[.,]|$)", "$1")
        amount = F.concat(F.array(joined, F.regexp_replace(joined, "[^0-9]", "")), long_parts)
        code = F.concat(F.array(token), F.filter(F.split(token, "/"), lambda s: s != ""), long_parts)
        return F.when(F.size(parts) <= 1, F.array(token)).otherwise(F.array_distinct(F.when(token.rlike(NOMINAL), amount).otherwise(code)))

    return F.flatten(F.transform(trimmed, forms))


def keywords(text: Column) -> Column:
    """Surface tokens that carry meaning, in order."""
    return F.filter(surface_tokens(text), lambda t: ~t.isin(STOPWORDS) & ((F.length(t) >= 2) | t.rlike(r"^\p{Nd}+$")))


def clean_text(text: Column) -> Column:
    """One kind of line end, no control characters, single blanks, at most one empty line in a row."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, CONTROL, "")
    t = F.regexp_replace(F.regexp_replace(t, " ", " "), "​", "")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def garbage_reason(text: Column) -> Column:
    """Why a text looks like a binary file read as text, judged by its first 4000 characters; null if it doesn't."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4000)
    broken = F.regexp_count(head, F.lit("�"))
    control = F.regexp_count(head, F.lit(CONTROL))
    marks = F.regexp_count(head, F.lit(BINARY_MARKS))
    return (
        F.when(F.length(head) == 0, F.lit(None))
        .when(broken / F.length(head) > 0.10, F.lit("replacement"))
        .when(control > 20, F.lit("control"))
        .when(marks >= 4, F.lit("markers"))
        .when((marks >= 2) & ((broken > 0) | (control > 5)), F.lit("markers_broken"))
    )


def foreign_chars(text: Column) -> Column:
    """Every character of a script that neither Indonesian nor English uses, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FOREIGN), F.lit(0))


def foreign_not_in(text: Column, source: Column) -> Column:
    """Foreign characters that the source does not hold."""
    return F.filter(foreign_chars(text), lambda c: ~F.contains(F.coalesce(source, F.lit("")), c))


def strip_foreign(text: Column, chars: Column) -> Column:
    """``text`` without those characters, its punctuation tidied."""
    t = F.aggregate(F.array_distinct(chars), text, lambda acc, c: F.replace(acc, c, F.lit(" ")))
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    t = F.regexp_replace(t, r"([,.;:!?])\s*([,.;:!?])+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\s+([,.;:!?])", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\(\s*\)", ""), r"\[\s*\]", "")
    return clean_text(F.regexp_replace(t, r"(?m)^[ \t]*[-*|]\s*$", ""))


def hint_count(text: Column, hints: list[str]) -> Column:
    """Non-overlapping occurrences of each hint, added up."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(h)) for h in hints])


def detect_language(text: Column) -> Column:
    """``id`` or ``en`` by common words in the first 4000 characters; ties go to ``id``."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 4000))
    return F.when(hint_count(head, INDONESIAN_HINTS) >= hint_count(head, ENGLISH_HINTS), "id").otherwise("en")


def estimate_tokens(text: Column) -> Column:
    """Tokens a text will take: the greater of what its words and its characters suggest."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_count(t, F.lit(r"[^\s\x1c-\x1f\x85\xa0]+"))
    size = F.greatest(words * F.lit(TOKENS_PER_WORD), F.length(t) / F.lit(6.0))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(size).cast("int")))


def fingerprint(text: Column) -> Column:
    """Lower case, single blanks: equal for texts that differ in case and white space only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def query_key(text: Column) -> Column:
    """A question's identity: its fingerprint without signs at either end."""
    return F.regexp_replace(fingerprint(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def sparse_text(name: Column, section: Column, content: Column) -> Column:
    """What the lexical index sees of a chunk."""
    head = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(section, F.lit("")))
    body = F.coalesce(content, F.lit(""))
    return F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body)


def contextual_text(name: Column, section: Column, content: Column) -> Column:
    """What the embedder sees of a chunk."""
    head = F.concat_ws(" | ", F.nullif(name, F.lit("")), F.nullif(section, F.lit("")))
    body = F.coalesce(content, F.lit(""))
    return F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body)


def html_title(html: Column, fallback: Column | None = None) -> Column:
    """The title of a page, at most 120 characters."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.substring(F.trim(F.regexp_replace(F.regexp_replace(raw, r"<[^>]+>", " "), r"\s+", " ")), 1, 120)
    return F.when(title != "", title).otherwise(fallback if fallback is not None else F.lit(""))


def citation_numbers(text: Column) -> Column:
    """Sorted distinct n of every ``[n]`` with one to three digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([0-9]{1,3})\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def clean_citations(text: Column, count: Column) -> Column:
    """``text`` without ``[n]`` for n outside 1..count."""
    bad = F.filter(citation_numbers(text), lambda n: (n < 1) | (n > count))
    cut = F.aggregate(bad, text, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"\[0*"), n.cast("string"), F.lit(r"\]")), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"[ \t]{2,}", " "), r"\s+([.,;:!?])", "$1"))


def redact(text: Column, key_prefixes: tuple[str, ...] = ()) -> Column:
    """Masks credentials, and words that begin like the caller's own keys."""
    own = [(rf"\Q{p}\E[A-Za-z0-9_]{{10,}}", "***") for p in key_prefixes]
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), [*own, *SECRET_PATTERNS], text)


def injection_markers(text: Column) -> Column:
    """The known phrases of prompt injection that a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(m) for m in INJECTION_MARKERS]), lambda m: F.contains(low, m))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fence(chunk_id: Column, name: Column, page: Column, content: Column, section: Column, note: Column) -> Column:
    """A chunk as evidence in a prompt; its text can't close the fence around it."""
    inert = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?i)<(/?\s*retrieved_document\s*)>", "\u2039$1\u203a")
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), one_line(name)),
        F.when(one_line(section) != "", F.concat(F.lit("Section: "), one_line(section))),
        F.when(page.isNotNull(), F.concat(F.lit("Page: "), page.cast("string"))),
        F.concat(F.lit("Chunk: "), chunk_id),
        F.nullif(note, F.lit("")),
    )
    return F.concat(F.lit("<retrieved_document>\n[DOCUMENT]\n"), head, F.lit("\n[CONTENT]\n"), inert, F.lit("\n</retrieved_document>"))


def json_in(text: Column) -> Column:
    """The JSON that a model's answer holds: all of it, fences aside, or else from the first opening to the last closing brace; null if neither parses."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    bare = F.when(F.startswith(trimmed, F.lit("```")), F.trim(F.rtrim(F.trim(F.regexp_replace(trimmed, "^```[a-zA-Z]*", ""), F.lit(" \t\r\n")), F.lit("`")), F.lit(" \t\r\n"))).otherwise(trimmed)
    inner = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    parses = lambda c: F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull()
    return F.when(parses(bare), bare).when(parses(inner), inner)
