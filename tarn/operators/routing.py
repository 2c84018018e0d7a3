"""What a question asks for, by its words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import keywords

#: The words and patterns of intents, and the names of capabilities.
EXTRACT = ("ambil data", "ekstrak", "extract", "tabel data", "json", "daftar data", "rekap data")
SUMMARY = (
    "ringkas", "ringkasan", "rangkum", "summary", "summarize", "ikhtisar", "intisari",
    "garis besar", "poin utama", "poin penting", "pokok-pokok", "key points", "overview",
)
SEARCH = ("cari", "temukan pasal", "di mana disebut", "sebutkan halaman", "list", "find")
AGGREGATE = (
    r"(?i)\b(total|jumlah(?:kan)?|rata-?rata|rerata|average|sum|count|hitung(?:kan)?|berapa banyak|"
    r"terbanyak|tersedikit|tertinggi|terendah|terbesar|terkecil|paling|maksimum|minimum|median|"
    r"persen(?:tase)?|rekap(?:itulasi)?|peringkat|ranking|top\s*\d+|urutkan|per\s+(?:bulan|tahun|hari|minggu))\b"
)
FULL_DOCUMENT = r"(?i)\b(seluruh|semua|lengkap|keseluruhan|daftar|list|all|full|struktur|ringkas(?:an|kan)?|rangkum(?:an)?|rekap|overview|garis besar)\b"
MULTI_DOCUMENT = (
    r"(?i)\b(banding\w*|perbandingan|bedanya|perbedaan|beda|persamaan|versus|vs|masing-masing|"
    r"semua\s+(dokumen|cabang|unit|divisi|wilayah)|setiap\s+(dokumen|cabang|unit|divisi|wilayah)|"
    r"compare|comparison|difference|each)\b"
)
SUMMARY_REQUEST = (
    r"(?i)\b(ringkas\w*|meringkas|rangkum\w*|merangkum|ikhtisar|intisari|resume|simpulkan|kesimpulan|"
    r"garis besar|poin(?:-poin)? (?:utama|penting|kunci)|pokok-pokok|gambaran umum|"
    r"summar\w*|recap|overview|key points|main points|tl;?dr)\b"
)
#: Fixed value: words that say what form a summary has, not what it is about.
SUMMARY_FORM = tuple(
    """
    buat buatkan bikin bikinkan tolong mohon coba minta berikan beri kasih tuliskan tulis jelaskan
    sajikan susun susunkan tampilkan sebutkan dong ya saja aja kah
    ringkas ringkasan ringkaskan meringkas rangkum rangkuman rangkumkan merangkum ikhtisar intisari
    resume rekap rekapan simpulkan kesimpulan garis besar inti pokok gambaran umum overview
    summary summarize summarise summarized recap outline tldr
    poin point points butir hal utama penting kunci key main highlight highlights
    singkat singkatnya padat jelas lengkap detail secara bentuk format bullet list daftar nomor
    paragraf kalimat kata
    isi konten dokumen dokumennya document documents file files berkas berkasnya materi knowledge
    upload unggah unggahan diunggah diupload semua seluruh keseluruhan ketiga kedua keempat
    kelima masing tiap setiap ini itu tersebut tadi di atas atas
    dari dan atau yang untuk dalam tentang ke dengan saya aku kami kita user pengguna
    the a an of all each every these those this that for in into on about me us please give make
    write create my our
    """.split()
)
REFERENCE = r"(?i)\b(itu|tersebut|tadi|sebelumnya|kalau|bagaimana dengan|yang (?:pertama|kedua|ketiga|terakhir|lain)|lainnya|that|those|it|them)\b"
FOLLOW_UP_WORDS = 6
#: The names of capabilities and what else routers call them.
ALIASES = {
    "knowledge_query": "knowledge_query",
    "query": "knowledge_query",
    "rag": "knowledge_query",
    "ask": "knowledge_query",
    "knowledge_search": "knowledge_search",
    "search": "knowledge_search",
    "retrieve": "knowledge_search",
    "knowledge_extract": "knowledge_extract",
    "extract": "knowledge_extract",
    "structured": "knowledge_extract",
    "knowledge_summary": "knowledge_summary",
    "summary": "knowledge_summary",
    "summarize": "knowledge_summary",
    "summarise": "knowledge_summary",
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def route(query: Column) -> Column:
    """capability, confidence and reason by key words; extraction before summary before search."""
    pick = lambda name, sure, why: F.struct(F.lit(name).alias("capability"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(_any(query, EXTRACT), pick("knowledge_extract", 0.5, "keyword:extract"))
        .when(_any(query, SUMMARY), pick("knowledge_summary", 0.5, "keyword:summary"))
        .when(_any(query, SEARCH), pick("knowledge_search", 0.45, "keyword:search"))
        .otherwise(pick("knowledge_query", 0.4, "default"))
    )


def capability(value: Column) -> Column:
    """The capability that a router's answer names, or null."""
    name = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    return F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), name)


def intents(query: Column) -> Column:
    q = F.coalesce(query, F.lit(""))
    return F.struct(
        q.rlike(AGGREGATE).alias("aggregate"),
        q.rlike(FULL_DOCUMENT).alias("full_document"),
        q.rlike(MULTI_DOCUMENT).alias("multi_document"),
        q.rlike(SUMMARY_REQUEST).alias("summary"),
        ((F.size(keywords(q)) <= 3) | q.rlike(REFERENCE)).alias("follow_up"),
    )


def generic_summary(query: Column) -> Column:
    """Whether a request for a summary names no topic: nothing but numbers and words of form is left of it."""
    form = F.array(*[F.lit(w) for w in sorted(set(SUMMARY_FORM))])
    return F.size(F.filter(keywords(F.coalesce(query, F.lit(""))), lambda w: ~F.array_contains(form, w) & ~w.rlike(r"^\p{Nd}+$"))) == 0


def retrieval_query(query: Column, previous: Column) -> Column:
    """A short question together with the one before it."""
    short = (F.size(keywords(query)) <= FOLLOW_UP_WORDS) & (F.coalesce(previous, F.lit("")) != "")
    return F.when(short, F.concat(previous, F.lit("\n"), query)).otherwise(query)
