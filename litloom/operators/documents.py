"""Parsing of pages into sections, and cutting of documents into chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions.fuzzy import ratio
from litloom.session import parallel, ship

# The target and the limit of a chunk, and the words below which a section joins the next.
TARGET, LIMIT, SHORT = 350, 480, 40
PARSED = "struct<title string, sections array<struct<path string, level int, paragraphs array<string>, tables array<struct<caption string, rows array<array<string>>>>, captions array<string>>>, references int, errors int, words int>"
_SKIP = {"script", "style", "nav", "head", "noscript", "template", "footer", "aside"}
_DROPPED = re.compile(r"ltx_bibliography|ltx_note|ltx_acknowledgement|\bad\b|\bads\b|advert")
_VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "col", "area", "base"}


class _Page(HTMLParser):
    """Sections of one page.  Unclosed tags are tolerated: a block ends where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.sections, self.path = "", [], []
        self.skip, self.open, self.kind, self.held = 0, [], None, []
        self.references = self.errors = self.figures = 0
        self.table: list | None = None
        self.caption, self.boxed = "", 0
        self.begin("", 1)

    def begin(self, path: str, level: int) -> None:
        self.sections.append({"path": path, "level": level, "paragraphs": [], "tables": [], "captions": []})

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        kind, self.kind, self.held = self.kind, None, []
        if not text or kind is None:
            return
        here = self.sections[-1]
        if kind == "h1" and not self.title:
            self.title = text
        elif kind in ("h1", "h2", "h3", "h4", "h5", "h6"):
            depth = max(0, int(kind[1]) - 2)
            self.path = [*self.path[:depth], text]
            self.begin(" > ".join(self.path), min(len(self.path), 3))
        elif kind in ("td", "th") and self.table is not None:
            self.table[-1].append(text)
        elif kind in ("caption", "figcaption"):
            if self.table is not None or self.boxed:  # it belongs to the table around or beside it
                self.caption = text
            else:
                here["captions"].append(text)
        elif kind in ("p", "li"):
            here["paragraphs"].append(text)

    def handle_starttag(self, tag, attrs) -> None:
        named = dict(attrs)
        classes = named.get("class") or ""
        if tag in _VOID:
            if tag == "br":
                self.held.append(" ")
            return
        self.open.append(tag)
        if "ltx_ERROR" in classes:
            self.errors += 1
        if self.skip or tag in _SKIP or _DROPPED.search(classes) or "ltx_ERROR" in classes:
            if tag == "li" and self.skip:
                self.references += 1
            self.skip += 1
            return
        if tag == "math":
            self.held.append(_math(named.get("alttext") or "", named.get("display") == "block"))
            self.skip += 1
            return
        if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "caption", "figcaption"):
            self.flush()
            self.kind = tag
        elif tag == "figure":
            self.flush()
            if "ltx_table" in classes.split():
                self.boxed = len(self.open)
        elif tag == "table":
            self.flush()
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.flush()
            self.table.append([])

    def handle_endtag(self, tag) -> None:
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if self.skip:
                self.skip -= 1
            elif last == self.kind:
                self.flush()
            if last == "table" and self.table is not None and not self.skip:
                self.flush()
                self.sections[-1]["tables"].append({"caption": self.caption, "rows": [r for r in self.table if r]})
                self.table, self.caption = None, ""
            if self.boxed > len(self.open):  # the end of a box: a caption below the table is the table's
                self.flush()
                tables = self.sections[-1]["tables"]
                if self.caption and tables and not tables[-1]["caption"]:
                    tables[-1]["caption"] = self.caption
                elif self.caption:
                    self.sections[-1]["captions"].append(self.caption)
                self.boxed, self.caption = 0, ""
            if last == tag:
                break

    def handle_data(self, data) -> None:
        if not self.skip:
            self.held.append(data)


def _math(latex: str, display: bool) -> str:
    """Inline ``$x$``; display `` $$x$$ ``, or a placeholder where it is longer than 300 characters."""
    latex = latex.replace("\\displaystyle", "").strip()
    if not display:
        return f"${latex}$"
    return " [equation] " if len(latex) > 300 else f" $${latex}$$ "


def parse_html(html: str | None) -> dict:
    """title, sections, references, errors, words.  NULL and empty pages have no sections."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    sections = [s for s in page.sections if s["paragraphs"] or s["tables"] or s["captions"]]
    return {"title": page.title, "sections": sections, "references": page.references, "errors": page.errors, "words": sum(len(t.split()) for s in sections for t in _texts(s))}


def _texts(section: dict) -> list[str]:
    """All text of a section: paragraphs, captions, tables with their captions."""
    return [*section["paragraphs"], *section["captions"], *[t for x in section["tables"] for t in [x["caption"], *[c for row in x["rows"] for c in row]]]]


def parse_markdown(text: str | None) -> dict:
    """Sections of a text with ``#`` or numbered headings, tables between bars and captions; the list
    of references is left out until an appendix begins."""
    sections = [{"path": "", "level": 1, "paragraphs": [], "tables": [], "captions": []}]
    path, dropping, dropped, block, table = [], False, 0, [], []

    def close() -> None:
        nonlocal block, table
        joined = " ".join(" ".join(block).split())
        if re.match(r"(?:Figure|Table|Fig\.)\s*\d+[.:]", joined):
            sections[-1]["captions"].append(joined)
        elif re.search(r"[^\W\d_]{2}", joined):
            sections[-1]["paragraphs"].append(joined)
        rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in table if not re.fullmatch(r"[|\s:\-]+", r)]
        if rows:
            caption = sections[-1]["captions"].pop() if sections[-1]["captions"] and sections[-1]["captions"][-1].startswith("Table") else ""
            sections[-1]["tables"].append({"caption": caption, "rows": rows})
        block, table = [], []

    for line in (text or "").split("\n"):
        mark = re.match(r"(#{1,6})\s+(.+)", line) or re.match(r"(\d+(?:\.\d+)*)\.?\s+([A-Z][^.]{2,70})$", line)
        if mark:
            close()
            depth = len(mark[1]) - 1 if mark[1][0] == "#" else mark[1].count(".")
            name = mark[2].strip()
            dropping = bool(re.fullmatch(r"(?i)(references|bibliography)", name)) or dropping and not re.match(r"(?i)append|[A-Z]\s", name)
            path = [*path[:depth], name]
            if not dropping:
                sections.append({"path": " > ".join(path), "level": min(len(path), 3), "paragraphs": [], "tables": [], "captions": []})
        elif dropping:
            dropped += bool(line.strip())
        elif line.startswith("|"):
            table.append(line)
        elif line.strip():
            block.append(line)
        else:
            close()
    close()
    kept = [s for s in sections if s["paragraphs"] or s["tables"] or s["captions"]]
    words = sum(len(t.split()) for s in kept for t in _texts(s))
    return {"title": "", "sections": kept, "references": dropped, "errors": 0, "words": words}


def parse_pages(pages: DataFrame, column: str, parser=parse_html) -> DataFrame:
    """Adds ``parsed``."""

    @F.pandas_udf(PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parser(t) for t in texts], columns=["title", "sections", "references", "errors", "words"])

    return pages.withColumn("parsed", parse(F.col(column)))


def _of_class(html: Column, name: str) -> Column:
    """How many elements carry the class."""
    return F.size(F.regexp_extract_all(html, F.lit(rf"""class\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?')"""), F.lit(0)))


def page_reason(html: Column, least_words: int = 1500, least_sections: int = 2) -> Column:
    """Why a page is no full text, '' if it is one: six checks, the first that fails.  NULL pages have no
    main part."""
    page = F.coalesce(html, F.lit(""))
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    inner = F.regexp_extract(page, r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)
    text = F.regexp_replace(F.regexp_replace(inner, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return (
        F.when(title.contains("No content available"), "no content").when(page.contains("ar5iv-severity-fatal"), "fatal conversion error")
        .when(_of_class(page, "ltx_missing") > 0, "missing element").when(_of_class(page, "ltx_page_main") == 0, "no main part")
        .when(T.word_count(text) < least_words, "too few words").when(_of_class(page, "ltx_section") < least_sections, "too few sections").otherwise("")
    )


def body_size(parsed: Column) -> Column:
    """Characters of all paragraphs, captions, table captions and cells, one between any two."""
    texts = F.flatten(F.transform(parsed["sections"], lambda s: F.concat(
        s["paragraphs"], s["captions"], F.flatten(F.transform(s["tables"], lambda t: F.concat(F.array(t["caption"]), F.flatten(t["rows"])))))))
    return F.coalesce(F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t)) + F.greatest(F.lit(0), F.size(texts) - 1), F.lit(0))


def better_parse(first: Column, second: Column) -> Column:
    """``first``, ``second`` or ``failed``: a poor parse (under 3 sections or 5,000 characters) gives way
    to a longer one, and fails if what remains is poor."""
    poor = lambda p: (F.size(p["sections"]) < 3) | (body_size(p) < 5000)
    swap = poor(first) & (body_size(second) > body_size(first))
    return F.when(swap, F.when(poor(second), "failed").otherwise("second")).otherwise(F.when(poor(first), "failed").otherwise("first"))


def budgeted(parts: Column, words: int) -> Column:
    """The parts that hold words, up to the one that reaches the budget, which is cut to what is left."""
    kept = F.filter(F.transform(parts, T.clean_space), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        cut = F.slice(F.split(p, " "), F.lit(1), F.greatest(F.lit(1), words - acc["n"]))
        more = F.struct(F.concat(acc["out"], F.array(F.array_join(cut, " "))).alias("out"), (acc["n"] + F.size(F.split(p, " "))).alias("n"))
        return F.when(acc["n"] >= words, acc).otherwise(more)

    return F.aggregate(kept, empty, step)["out"]


_REFERENCE = re.compile(r"\(\d{4}[a-z]?\)|\b(?:19|20)\d{2}[a-z]?\.|^\[\d+\]", re.M)
_HEAD = re.compile(r"(?i)^(appendix\s+)?([a-z]|\d+)(\.\d+)*\.?\s+")


def heading_f1(first: dict, second: dict, same: float = 85.0) -> float:
    """F1 of the section headings of two parses, alike from a ratio of ``same``; 0 where either has none."""
    a, b = ([_HEAD.sub("", s["path"].split(" > ")[-1]).lower() for s in p["sections"]] for p in (first, second))
    if not a or not b:
        return 0.0
    hits = lambda xs, ys: sum(any(ratio(x, y) >= same for y in ys) for x in xs) / len(xs)
    precision, recall = hits(b, a), hits(a, b)
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def word_recall(first: dict, second: dict) -> float:
    """The share of the first parse's words, with their numbers, that the second holds."""
    a, b = (Counter(re.findall(r"\w+", "\n".join(t for s in p["sections"] for t in _texts(s)).lower())) for p in (first, second))
    return sum((a & b).values()) / a.total() if a else 0.0


def compared(both: DataFrame, key: str) -> DataFrame:
    """both: key, first, second (parses) -> tag, first_sections, second_sections, heading_f1, word_recall,
    references_excluded: a row for each document and one for the means."""
    schema = "tag string, first_sections double, second_sections double, heading_f1 double, word_recall double, references_excluded double"
    ship(both.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, a, b in zip(batch[key], map(_plain, batch["first"]), map(_plain, batch["second"])):
                clean = not any(len(_REFERENCE.findall(" ".join(s["paragraphs"]))) >= 3 for s in b["sections"])
                out.append((str(k), float(len(a["sections"])), float(len(b["sections"])), round(heading_f1(a, b), 3), round(word_recall(a, b), 3), float(clean)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    rows = both.select(key, "first", "second").mapInPandas(run, schema)
    mean = rows.agg(F.lit("mean").alias("tag"), *[F.round(F.avg(c), 3).alias(c) for c in rows.columns[1:]])
    return rows.unionByName(mean)


def packed(units: Column, target: int = TARGET, separator: str = "\n") -> Column:
    """Greedy packing of units of text by token count: a unit starts a new chunk where the target would
    be passed; the first unit of a chunk is always taken.  A fold inside generated code.
    -> array<struct<n, text>>"""
    step = lambda acc, u: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["n"] + T.token_count(u) <= target),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((F.element_at(acc, -1)["n"] + T.token_count(u)).alias("n"), F.concat(F.element_at(acc, -1)["text"], F.lit(separator), u).alias("text")))),
    ).otherwise(F.concat(acc, F.array(F.struct(T.token_count(u).alias("n"), u.alias("text")))))
    return F.aggregate(units, F.array().cast("array<struct<n:int,text:string>>"), step)


_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9$(\[])")


def _count(text: str) -> int:
    return len(_TOKEN.findall(text))


def halves(text: str, limit: int) -> list[str]:
    """Halves by words, of one word by characters, until each piece fits."""
    if _count(text) <= limit or len(text) < 2:
        return [text]
    words = text.split()
    if len(words) > 1:
        left, right = " ".join(words[:len(words) // 2]), " ".join(words[len(words) // 2:])
    else:
        left, right = text[:len(text) // 2], text[len(text) // 2:]
    return halves(left, limit) + halves(right, limit)


def _pack(units: list[str], target: int, joiner: str, head: str = "") -> list[str]:
    out, held = [], []
    for unit in units:
        if held and _count(head) + _count(joiner.join([*held, unit])) > target:
            out.append(head + joiner.join(held))
            held = []
        held.append(unit)
    if held:
        out.append(head + joiner.join(held))
    return out


def chunks_of(parsed: dict, abstract: str | None = None, target: int = TARGET, limit: int = LIMIT, short: int = SHORT) -> list[tuple[str, str, str]]:
    """(section, kind, text): the abstract, then of each section text, tables and captions.  A short
    section that is not the last hands its paragraphs to the next one; its tables stay."""
    out = [("Abstract", "abstract", p) for p in halves(abstract, limit)] if abstract else []
    carried: list[str] = []
    for i, s in enumerate(parsed["sections"]):
        own = list(s["paragraphs"])
        if sum(len(p.split()) for p in own) < short and i + 1 < len(parsed["sections"]):
            carried += own
        else:
            units = []
            for p in carried + own:
                units += [p] if _count(p) <= limit else [h for piece in _pack(_SENTENCE.split(p), target, " ") for h in halves(piece, limit)]
            out += [(s["path"], "text", t) for t in _pack(units, target, "\n")]
            carried = []
        for table in s["tables"]:
            rows = [" | ".join(r) for r in table["rows"]]
            head = "\n".join(x for x in (table["caption"], rows[0] if rows else "") if x)
            body = _pack(rows[1:], target, "\n", head + "\n") if len(rows) > 1 else [head]
            out += [(s["path"], "table", t) for t in body if t]
        out += [(s["path"], "caption", c) for c in s["captions"]]
    return out


def chunk_documents(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """parsed: key, parsed, abstract -> key, chunk_no (from 0), section, kind, text, n_tokens.  A
    document is cut by itself: no shuffle."""
    schema = f"{key} bigint, chunk_no int, section string, kind string, text string, n_tokens int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *c, _count(c[2])) for k, p, a in zip(batch[key], batch["parsed"], batch["abstract"]) for i, c in enumerate(chunks_of(_plain(p), a))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return parsed.select(key, "parsed", "abstract").mapInPandas(run, schema)


def _plain(parsed) -> dict:
    """Rows and arrays as they come out of Arrow, as dicts and lists."""
    if parsed is None:
        return {"sections": []}
    parsed = parsed.asDict(True) if hasattr(parsed, "asDict") else parsed
    fix = lambda s: s.asDict(True) if hasattr(s, "asDict") else dict(s)
    return {"sections": [
        {"path": s["path"], "paragraphs": list(s["paragraphs"]), "captions": list(s["captions"]), "tables": [{"caption": t["caption"], "rows": [list(r) for r in t["rows"]]} for t in map(fix, s["tables"])]}
        for s in map(fix, parsed["sections"])
    ]}


def inverted_index(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, index: map of each distinct word to its positions (from 0).  Inside the
    row: nothing is shuffled."""
    words = F.split(T.clean_space(F.col("text")), " ")
    rows = parallel(docs).select("doc_id", "text").select("doc_id", words.alias("w"))

    @F.pandas_udf("map<string,array<int>>")
    def index(batch: pd.Series) -> pd.Series:
        out = []
        for w in batch:
            held: dict[str, list[int]] | None = None if w is None else {}
            for i, word in enumerate(w if w is not None else ()):
                held.setdefault(word, []).append(i)
            out.append(held)
        return pd.Series(out)

    return rows.select("doc_id", index("w").alias("index"))


def rebuilt(index: DataFrame) -> DataFrame:
    """doc_id, text: the words of an inverted index in the order of their positions."""
    return index.select("doc_id", F.when(F.col("index").isNotNull(), from_inverted(F.col("index"))).alias("text"))


def from_inverted(index: Column) -> Column:
    """The text whose words stand at the given positions; '' for NULL."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["w"]), " "), F.lit(""))
