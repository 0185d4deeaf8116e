"""Main text of web pages by consensus of the host.

Pages are read twice.  First each page's containers are scored by how much of
the page's clean text they hold, how little of it is link text, and what their
tags and classes say; the page votes for the generalised path of its best one:
tags and classes from the root, digits removed.  Spark counts the votes per
host and keeps the ``PATHS`` best of every host.  Then every page is extracted
again from the containers on its host's winning path; a page on which no
winning path holds ``COVERED`` of the clean text uses its own best container.

Inside the container, menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out, by tag, role or
class.  Nothing else is dropped or cut.  Blocks are the texts between block
tags; character references are decoded, white space becomes one space, and
blocks are joined in page order by an empty line.  Line breaks are white space.

Votes are counted with partial aggregates, so a hot host costs one row per
task and path; the winners, one short list per host, are joined by broadcast
while their measured size is below ``BROADCAST_BYTES``, else by a join that
spreads every host over ``SALTS`` groups.  Paths longer than 200 characters are
replaced by their digest.

Null and empty html, and pages without text, give an empty text.  Null urls
and urls without ``://`` share the host ''.  Repeated rows are all extracted.
Only page_id, url and html are read; other columns do not matter, whatever their names.  Time and
memory are linear in the length of a page, however deep or broken its tags.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import stage

PATHS = 4
COVERED = 0.5
NEARLY = 0.7                # a deeper container wins with this share of the best score
BROADCAST_BYTES = 32_000_000
SALTS = 64

# Names of HTML elements and what pages call their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
    search section summary table tbody tfoot thead tr ul""".split())
CONTAINERS = frozenset("article body blockquote center div main section table tbody td tr ul ol dl html".split())
HARD = frozenset("aside button dialog footer head menu nav noscript object search".split())
SOFT_TAGS = frozenset(["form", "header"])
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
REMARKS = frozenset("comment comments commentlist discussion disqus replies reviews".split())
BOILERPLATE = frozenset("""ad ads adv advert advertisement advertising adverts adsense announcement banner breadcrumb
    breadcrumbs consent cookie cookies copyright dfp disclaimer footer gdpr header hidden login masthead menu modal nav
    navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted
    promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription
    taboola toolbar topbar widget widgets""".split()) | REMARKS
GOOD = frozenset("article articlebody body content entry main maincontent post story text".split())
SCOPES = frozenset("html table td th caption button object".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "a": ("a",), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead")}

QUOTED = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN, PLAIN = (re.compile(rf"""<(?:!--(?:.*?)(?:--!?>|\Z)
    |(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>{inner})(?P<closed>>?)
    |[!?/][^>]*+>?)""", re.S | re.X) for inner in (QUOTED, "[^>]*+"))
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}


def _judge(tag: str, more: str) -> tuple[str, str, bool, bool, bool]:
    """Path step, kind of drop ('', 'soft' or 'hard'), good name, and whether it holds remarks."""
    found = {k.lower(): html_lib.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(more)} if "=" in more else {}
    names = found.get("class", "").split()
    pieces = [p.lower() for p in PIECE.findall(f"{found.get('class', '')} {found.get('id', '')}")]
    step = tag + "".join(f".{n}" for n in sorted({re.sub(r"\d+", "", x).strip("-_") for x in names} - {""}))
    role = found.get("role", "").lower()
    style = re.sub(r"\s", "", found.get("style", "").lower())
    bare = re.sub(ATTRIBUTE, " ", more).lower().split() if more else []
    remarks = tag not in ("html", "body") and not REMARKS.isdisjoint(pieces)
    good = tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower() \
        or not GOOD.isdisjoint(pieces)
    if tag in HARD or remarks or role in DROP_ROLES or "hidden" in bare or "hidden" in found or "display:none" in style \
            or found.get("aria-hidden", "").lower() == "true":
        return step, "hard" if tag not in ("html", "body") else "", good, remarks, tag in ("article", "main")
    named = tag not in ("html", "body", "article", "main") and not BOILERPLATE.isdisjoint(pieces)
    return step, "soft" if named or tag in SOFT_TAGS else "", good and not named, False, tag in ("article", "main")


class Page:
    """Elements of a page in document order, with their text runs.

    The elements below element e are e .. last[e]; a run is (block number,
    element, text).  ``clean[e]`` is the length of the text in e that is not
    dropped, ``linked[e]`` the part of it inside links."""

    def __init__(self, html: str | None, known: dict):
        self.tags, self.paths, self.kinds, self.good, self.last, self.parent = ["#"], [""], [""], [False], [0], [-1]
        self.core = [False]
        self.runs: list[tuple[int, int, str]] = []
        self._read(html or "", known)
        self._lift()
        self._measure()

    def _read(self, html: str, known: dict) -> None:
        stack, open_tags, block, at, size = [0], {}, 0, 0, len(html)
        paragraphs, scopes = [], [0]                  # stack heights of open paragraphs and of the scopes that hide them

        def close(height: int) -> None:
            while len(stack) > height:
                e = stack.pop()
                self.last[e] = len(self.tags) - 1
                open_tags[self.tags[e]] -= 1
            while paragraphs and paragraphs[-1] >= height:
                paragraphs.pop()
            while scopes[-1] and scopes[-1] >= height:
                scopes.pop()

        def note(text: str) -> None:
            if text and not text.isspace():
                self.runs.append((block, stack[-1], html_lib.unescape(text) if "&" in text else text))
            elif text:
                self.runs.append((block, stack[-1], " "))

        tokens = TOKEN
        while at < size:
            m = tokens.search(html, at)
            if m is None:
                note(html[at:])
                break
            note(html[at:m.start()])
            if m["tag"] and not m["closed"] and tokens is TOKEN:
                tokens, at = PLAIN, m.start()         # a quote that never ends: from here on quotes do not hide >
                continue
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br" or tag in ("td", "th"):
                self.runs.append((block, stack[-1], " "))
            if tag in BLOCK:
                block += 1
            if m["end"]:
                if open_tags.get(tag):
                    height = len(stack) - 1
                    while self.tags[stack[height]] != tag:
                        height -= 1
                    close(height)
                continue
            if tag in BLOCK and paragraphs and paragraphs[-1] > scopes[-1]:
                close(paragraphs[-1])
            if tag in CLOSES:
                height = len(stack) - 1
                while height > 0 and self.tags[stack[height]] in CLOSES[tag] + ("b", "i", "a", "span", "em", "strong", "p"):
                    if self.tags[stack[height]] in CLOSES[tag]:
                        close(height)
                        height = len(stack)
                    height -= 1
            if tag == "body" and open_tags.get("body") or tag == "html" and open_tags.get("html"):
                continue
            if tag in VOID:
                continue
            if tag == "body" and open_tags.get("head"):
                close(next(h for h, e in enumerate(stack) if self.tags[e] == "head"))
            if tag in RAW:
                if not m["more"].endswith("/"):
                    end = RAW_END[tag].search(html, at)
                    at = end.end() if end else size
                continue
            more = m["more"]
            key = (tag, more)
            judged = known.get(key)
            if judged is None:
                judged = _judge(tag, more)
                if len(known) < 20_000 and len(more) < 200:
                    known[key] = judged
            step, kind, good, _, core = judged
            path = f"{self.paths[stack[-1]]}/{step}"
            if len(path) > 200:
                path = "md5:" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()
            self.parent.append(stack[-1])
            stack.append(len(self.tags))
            if tag == "p":
                paragraphs.append(len(stack) - 1)
            elif tag in SCOPES:
                scopes.append(len(stack) - 1)
            self.tags.append(tag)
            self.paths.append(path)
            self.kinds.append(kind)
            self.good.append(good)
            self.core.append(core)
            self.last.append(0)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        open_tags["#"] = 1
        close(0)

    def _lift(self) -> None:
        """Keep a form, header or named part after all if it wraps the page's article, or most of its paragraphs."""
        total, inside = 0, [0] * len(self.tags)
        core, titled = list(self.core), [t == "h1" for t in self.tags]
        for _, e, text in self.runs:
            if self.kinds[e] != "hard":
                inside[e] += len(text)
        dropped = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            dropped[e] = dropped[self.parent[e]] or self.kinds[e] == "hard"
        for e in range(len(self.tags) - 1, 0, -1):
            if dropped[e]:
                inside[e], core[e], titled[e] = 0, False, False
            p = self.parent[e]
            inside[p] += inside[e]
            core[p] |= core[e]
            titled[p] |= titled[e]
        total = inside[0]
        in_article = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            in_article[e] = in_article[self.parent[e]] or self.core[e]
            if self.kinds[e] == "soft":
                wraps = (core[e] and not self.core[e]) or (titled[e] and inside[e] > 0.5 * total)
                if self.tags[e] == "header":
                    wraps = wraps or (titled[e] and in_article[e])
                elif self.tags[e] == "form":
                    wraps = wraps or inside[e] > 0.7 * total
                if wraps:
                    self.kinds[e] = ""

    def _measure(self) -> None:
        n = len(self.tags)
        self.dropped, link = [False] * n, [False] * n
        for e in range(1, n):
            p = self.parent[e]
            self.dropped[e] = self.dropped[p] or self.kinds[e] != ""
            link[e] = link[p] or self.tags[e] == "a"
        self.clean, self.linked = [0] * n, [0] * n
        for _, e, text in self.runs:
            if not self.dropped[e]:
                size = len(text) - text.count(" ")
                self.clean[e] += size
                if link[e]:
                    self.linked[e] += size
        for e in range(n - 1, 0, -1):
            self.clean[self.parent[e]] += self.clean[e]
            self.linked[self.parent[e]] += self.linked[e]

    def best(self) -> int:
        """The best container (0, the whole page, if no text is left)."""
        top, scores = 0.0, {}
        for e in range(1, len(self.tags)):
            if self.tags[e] in CONTAINERS and not self.dropped[e] and self.clean[e]:
                share = self.clean[e] / self.clean[0]
                score = share * (1.0 - self.linked[e] / self.clean[e]) * (1.5 if self.core[e] else 1.25 if self.good[e] else 1.0)
                scores[e] = score
                top = max(top, score)
        chosen = 0
        for e, score in scores.items():               # document order: later is deeper or further on
            if score >= NEARLY * top and (chosen == 0 or e <= self.last[chosen] or score > scores[chosen]):
                chosen = e
        return chosen

    def on(self, path: str) -> list[int]:
        """Outermost elements on a path that are not dropped."""
        out: list[int] = []
        for e, p in enumerate(self.paths):
            if p == path and not self.dropped[e] and not (out and e <= self.last[out[-1]]):
                out.append(e)
        return out

    def text(self, containers: list[int]) -> str:
        blocks, at, current, k = [], None, [], 0
        for block, e, text in self.runs:
            while k < len(containers) and e > self.last[containers[k]]:
                k += 1
            if k == len(containers):
                break
            if e < containers[k] or self.dropped[e]:
                continue
            if block != at:
                blocks.append(current)
                at, current = block, []
            current.append(text)
        blocks.append(current)
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n\n".join(b for b in joined if b)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes: how many pages of a host have their best container on a path."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            paths = []
            for text in batch.column("html"):
                page = Page(text.as_py(), known)
                paths.append(page.paths[page.best()])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])

    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string")
    return seen.where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))


def winning_paths(counted: DataFrame) -> DataFrame:
    """host, paths: the ``PATHS`` paths of a host with most votes, best first (ties by path)."""
    w = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    best = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PATHS)
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))),
                                                lambda s: s["path"]).alias("paths"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path: the main text of every page and the path it was taken from."""
    rows = pages.select("page_id", "url", "html")
    winners = stage(winning_paths(votes(rows)), "paths")
    size = F.length("host") + F.aggregate("paths", F.lit(0), lambda a, p: a + F.length(p)) + 100
    held = winners.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    rows = rows.withColumn("host", host_of(F.col("url")))
    if held <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        spread = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        copies = winners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("salt", spread).join(copies, ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts, paths = [], []
                for content, winning in zip(batch.column("html"), batch.column("paths")):
                    page = Page(content.as_py(), known)
                    chosen = [page.best()]
                    for path in winning.as_py() or ():
                        found = page.on(path)
                        if found and sum(page.clean[e] for e in found) >= COVERED * page.clean[0]:
                            chosen = found
                            break
                    texts.append(page.text(chosen))
                    paths.append(page.paths[chosen[0]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())],
                    names=["page_id", "url", "text", "n_chars", "path"])

    return joined.select("page_id", "url", "html", "paths").mapInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars long, path string")
