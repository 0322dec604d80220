"""Pages and blocks: HTML to blocks, cleaning, frontier, incremental builds."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TEXT_TAGS = {"h1", "h2", "h3", "h4", "p", "li"}
SCOPE_TAGS = {"article", "main"}
SCOPE_CLASSES = ("entry-content", "post-content", "article-content")
SKIPPED = {"script", "style", "noscript"}
VOID = {"br", "meta", "img", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


class _Blocks(HTMLParser):
    """Collects the title and the text blocks of a page; void tags open nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.scope = 0
        self.skip = 0
        self.title, self.blocks, self.every, self.now = [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        inside = tag in SCOPE_TAGS or any(c in (dict(attrs).get("class") or "") for c in SCOPE_CLASSES)
        self.stack.append((tag, inside))
        self.scope += inside
        self.skip += tag in SKIPPED
        if tag in TEXT_TAGS:
            self._flush()
            self.now = []

    def handle_endtag(self, tag):
        if tag in VOID or not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, inside = self.stack.pop()
            if t in TEXT_TAGS:
                self._flush()
            self.scope -= inside
            self.skip -= t in SKIPPED
            if t == tag:
                break

    def handle_data(self, data):
        if self.skip:
            return
        if any(t == "title" for t, _ in self.stack):
            self.title.append(data)
        elif self.now is not None:
            self.now.append(data)

    def _flush(self):
        if self.now is not None:
            line = " ".join("".join(self.now).split())
            if len(line) >= 3:
                self.every.append(line)
                if self.scope:
                    self.blocks.append(line)
        self.now = None

    def close(self):
        super().close()
        self._flush()


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, pos, text): blocks of headings, paragraphs and list items inside the article; of the whole page if it has none."""

    def work(batches):
        for pdf in batches:
            out = []
            for page, url, html in zip(pdf.page_id, pdf.url, pdf.html):
                p = _Blocks()
                p.feed(html or "")
                p.close()
                title = " ".join("".join(p.title).split())
                out += [(page, url, title, k, x) for k, x in enumerate(p.blocks or p.every)]
            yield pd.DataFrame(out, columns=["page_id", "url", "title", "pos", "text"])

    return pages.select("page_id", "url", "html").mapInPandas(work, "page_id long, url string, title string, pos int, text string")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, text): trimmed lines that are not blank."""
    rows = docs.select(F.col(id_col), F.posexplode(F.split(T.text(text_col), "\n")).alias("pos", "text"))
    return rows.withColumn("text", T.ws("text")).where("text <> ''")


def block_clean(blocks: DataFrame, navigation: DataFrame, phrases: list[str], title: Column | None = None) -> DataFrame:
    """Blocks without navigation lines (a small table, line), lines with a boilerplate phrase, echoes of the title and lines of two words or fewer."""
    rows = blocks.withColumn("_n", T.norm("text")).where(F.size(T.words("text")) > 2)
    for p in phrases:
        rows = rows.where(~F.col("_n").contains(p))
    if title is not None:
        rows = rows.where(F.col("_n") != T.norm(title))
    return rows.join(navigation.select(T.norm("line").alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def page_title(html: Column) -> Column:
    return T.ws(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1))


def page_doc(pages: DataFrame) -> DataFrame:
    """(page_id, title, doc_id): title without the site's suffix, id from its slug; pages without a paragraph are dropped."""
    title = F.trim(F.regexp_replace(page_title(F.col("html")), r" [|–-] [^|–-]*$", ""))
    return pages.where(F.col("html").contains("<p")).select("page_id", title.alias("title"), F.concat(F.lit("web-"), T.slug(title)).alias("doc_id"))


def url_frontier(pages: DataFrame, base: str, limit: int | None = None) -> DataFrame:
    """(url, page_id) of urls under a prefix, the first page of each, in order of the page."""
    w = Window.partitionBy("url").orderBy("page_id")
    rows = pages.where(F.col("url").startswith(base)).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("url", "page_id")
    return rows.orderBy("page_id").limit(limit) if limit else rows


def incremental(pages: DataFrame, existing: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages to process, one-row manifest): those whose url is not yet in the output."""
    todo = pages if force else pages.join(existing.select("url").distinct(), "url", "left_anti")
    counts = pages.agg(F.count("*").alias("urls")).crossJoin(todo.agg(F.count("*").alias("saved")))
    return todo, counts.withColumn("skipped", F.col("urls") - F.col("saved"))


def block_normalize(blocks: DataFrame, title: Column) -> DataFrame:
    """Trimmed blocks without ``posted on`` lines and lines equal to the title."""
    n = T.norm("text")
    return blocks.where((F.trim("text") != "") & ~n.startswith("posted on") & (n != T.norm(title)))


def cache_filename(url: Column) -> Column:
    return F.concat(F.substring(T.slug(url), 1, 80), F.lit("-"), F.substring(F.sha1(url), 1, 12))
