"""Main text of web pages: subtrees that recur over many pages of one host are template and are deleted.

Each page is parsed once into elements; a subtree's hash covers its tag, texts and children, not its attributes,
comments or scripts.  For each host Spark counts in how many different contents a block element's hash occurs; a page's content is all
its outermost article and main elements that hold text, or all of it where they hold less than half of the text outside its navigation, header,
footer and aside elements, so that thousands of copies of one article don't make its paragraphs a template.  A subtree
in at least MIN_PAGES contents, and MIN_ROOT times the square root of the host's contents (which grows far more slowly than the host, so that the menus of a large host's sections
go too), is deleted wherever it stands on that host; what
is left becomes text.

Plan: pages, with their elements, are shuffled once, compressed, into blocks by (host, content), so that equal contents meet; a block holds about BLOCK_HTML bytes of markup and is a task of its own; it sends one
row for each (host, subtree) with the number of contents, and one for each host it holds, which Spark sums (with map-side combination); the template
hashes of a host go to the blocks that hold the host, where they are
cogrouped with the pages, whose exchange is used again.  A hot host is spread over all blocks.

Parsing goes once from left to right: a tag that isn't closed before the end of the page is no tag, and from there on a tag ends at the next angle bracket, whatever its quotes.

Defined results: a null html gives null text and takes no part; an empty one gives an empty text; without a host (null or malformed url) nothing is
a template; a null page_id stays null; repeated rows are one content and each give a row; broken markup is closed where its parent ends; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import blocks_for, packed_by_block, read_blocks

MIN_PAGES, MIN_SHARE, MIN_ROOT = 5, 0.0, 0.25
BLOCK_HTML = 32 << 20
_OPEN = re.compile(r"<(?=[a-zA-Z!?/])")
_TAG = re.compile(r"""<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BROKEN = re.compile(r"<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
_BEGUN = re.compile(r"</?[a-zA-Z]|<[!?]")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "head")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CONTENT = frozenset(("article", "main"))
_FURNITURE = frozenset(("nav", "header", "footer", "aside"))
Element = tuple[int, int, int]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


def _hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) >> 1


def tags(html: str) -> Iterator[tuple[int, int, str | None, bool, bool]]:
    """(begin, end, name, closing, empty) of each tag, with no name for comments and declarations; the content of script and the like belongs to its tag."""
    at, pattern, no_end = 0, _TAG, set()
    while (m := _OPEN.search(html, at)) is not None:
        begin = m.start()
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = len(html) if end < 0 else end + 3
            yield begin, at, None, False, False
            continue
        m = pattern.match(html, begin)
        if m is None:
            if pattern is _TAG and _BEGUN.match(html, begin):
                pattern = _BROKEN  # it ran to the end of the page, once
            else:
                at = begin + 1
            continue
        at = m.end()
        if m.group(2) is None:
            yield begin, at, None, False, False
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        if name in _RAW and not closing and not m.group(3).endswith("/") and name not in no_end:
            raw_end = _RAW[name].search(html, at)
            if raw_end is None:
                no_end.add(name)
            if raw_end or name != "head":
                at = raw_end.end() if raw_end else len(html)
        yield begin, at, name, closing, m.group(3).endswith("/")


def parse(html: str) -> tuple[list[Element], int]:
    """The (hash, begin, end) of a page's block elements that hold anything, and the hash of its content."""
    found: list[Element] = []
    contents: list[bytes] = []
    # letters in content elements, and in those and outside all furniture; the number of open elements of each kind
    within = body = in_content = in_furniture = 0
    stack: list[tuple[str, int, list[bytes]]] = [("", 0, [])]

    def close(end: int) -> None:
        nonlocal in_content, in_furniture
        tag, begin, parts = stack.pop()
        open_tags[tag] -= 1
        h = _hash(tag.encode() + b"\0" + b"\1".join(parts))
        if parts:
            stack[-1][2].append(h.to_bytes(8, "little"))
            if tag in _BLOCK:
                found.append((h, begin, end))
        in_furniture -= tag in _FURNITURE
        if tag in _CONTENT:
            in_content -= 1
            if parts and not in_content:
                contents.append(h.to_bytes(8, "little"))

    def say(words: list[str]) -> None:
        nonlocal within, body
        line = " ".join(words)
        stack[-1][2].append(line.encode())
        if in_content:
            within += len(line)
        if in_content or not in_furniture:
            body += len(line)

    at = 0
    open_tags: Counter = Counter()
    for begin, end, tag, closing, empty in tags(html):
        words = html[at:begin].split()
        if words:
            say(words)
        at = end
        if tag is None:
            continue
        if closing:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    close(begin)
                close(at)
            continue
        ends = _ENDS.get(tag)
        if ends and stack[-1][0] in ends:
            close(begin)
        if tag in _VOID or tag in _RAW or empty:
            continue
        stack.append((tag, begin, []))
        open_tags[tag] += 1
        in_content += tag in _CONTENT
        in_furniture += tag in _FURNITURE
    words = html[at:].split()
    if words:
        say(words)
    while len(stack) > 1:
        close(len(html))
    whole = not contents or 2 * within < body
    return found, _hash(b"\1".join(stack[0][2] if whole else contents))


def without(html: str, found: list[Element], template: set[int]) -> tuple[str, int]:
    """The page without its outermost template subtrees, and their number."""
    pieces, at, n = [], 0, 0
    for h, begin, end in sorted(found, key=lambda e: (e[1], -e[2])):
        if begin >= at and h in template:
            pieces.append(html[at:begin])
            at, n = end, n + 1
    return " ".join([*pieces, html[at:]]), n


def text_of(html: str) -> str:
    """Visible text, one line a block."""
    out: list[str] = []
    at = 0
    for begin, end, tag, _, _ in tags(html):
        out.append(html[at:begin])
        at = end
        if tag in _BLOCK or tag == "br":
            out.append("\0")
    out.append(html[at:])
    lines = (" ".join(entities.unescape(line).split()) for line in "".join(out).split("\0"))
    return "\n".join(line for line in lines if line)


_PARSED = {"content": pa.int64(), "hashes": pa.list_(pa.int64()), "begins": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}


def _keyed(blocks: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, hosts = [], []
            parsed: dict[str, list] = {name: [] for name in _PARSED}
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                # without a host nothing is a template, so that the markup needn't be known
                found, content = parse(html) if html is not None and host else ([], _hash((html or "").encode("utf-8", "surrogatepass")))
                hosts.append(host)
                block.append(_hash(f"{host}\0{content}".encode()) % blocks)
                for name, value in zip(parsed, (content, *(zip(*found) if found else ((), (), ())))):
                    parsed[name].append(value)
            columns = [pa.array(block, pa.int32()), batch.column("page_id"), pa.array(hosts, pa.string()), batch.column("html"), *(pa.array(v, _PARSED[n]) for n, v in parsed.items())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "page_id", "host", "html", *parsed])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed_by_block(rows(batches))

    return pack


def _block_counts(table: pa.Table) -> pa.Table:
    """(host, subtree, n): a block's contents with each subtree; and (host, block, -contents) for each of its hosts."""
    contents: dict[tuple[str, int], set[int]] = {}
    for batch in read_blocks(table.column("body")):
        known = batch.column("html").is_valid().to_pylist()
        for host, content, hashes, there in zip(batch.column("host").to_pylist(), batch.column("content").to_pylist(), batch.column("hashes").to_pylist(), known):
            if host and there:
                contents.setdefault((host, content), set()).update(hashes)
    block = table.column("block")[0].as_py()
    subtrees = Counter((host, h) for (host, _), own in contents.items() for h in own)
    held = Counter(host for host, _ in contents)
    rows = [(_hash(host.encode()), h, n) for (host, h), n in subtrees.items()] + [(_hash(host.encode()), block, -n) for host, n in held.items()]
    host_keys, keys, counts = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(host_keys, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["host_key", "key", "n"])


def _clean(pages: pa.Table, templates: pa.Table) -> pa.Table:
    known = {k: set(t) for k, t in zip(templates.column("host_key").to_pylist(), templates.column("template").to_pylist())}
    ids, hosts, texts, removed = [], [], [], []
    for batch in read_blocks(pages.column("body")):
        ids.append(batch.column("page_id"))
        for host, html, *elements in zip(*(batch.column(n).to_pylist() for n in ("host", "html", "hashes", "begins", "ends"))):
            own = known.get(_hash(host.encode()), set()) if host else set()
            rest, n = without(html, list(zip(*elements)), own) if html is not None and own else (html, 0)
            hosts.append(host or None)
            texts.append(None if rest is None else text_of(rest))
            removed.append(n)
    return pa.table([pa.chunked_array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["page_id", "host", "text", "n_removed"])


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_root: float = MIN_ROOT) -> DataFrame:
    """(page_id, host, text, n_removed) of each page; a template is in at least min_pages contents of its host, min_share of them, and min_root times their square root."""
    wanted = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    size = wanted.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    blocks = blocks_for(size, BLOCK_HTML, pages.sparkSession.sparkContext.defaultParallelism)
    bodies = wanted.mapInArrow(_keyed(blocks), "block int, body binary").repartitionById(blocks, "block")
    counts = bodies.groupBy("block").applyInArrow(_block_counts, "host_key long, key long, n long").groupBy("host_key", "key").agg(F.sum("n").alias("n"))
    # conditions on the sum keep both kinds of row in the one exchange, which all three branches read
    held = counts.where("n < 0")
    totals = held.groupBy("host_key").agg((-F.sum("n")).alias("contents"))
    least = F.greatest(F.lit(float(min_pages)), F.lit(min_share) * F.col("contents"), F.lit(min_root) * F.sqrt("contents"))
    template = counts.where(F.col("n") >= min_pages).join(totals, "host_key").where(F.col("n") >= least)
    by_host = template.groupBy("host_key").agg(F.collect_list("key").alias("template"))
    answers = held.select("host_key", F.col("key").cast("int").alias("block")).join(by_host, "host_key").select("block", "host_key", "template")
    return bodies.groupBy("block").cogroup(answers.repartitionById(blocks, "block").groupBy("block")).applyInArrow(_clean, "page_id long, host string, text string, n_removed int")
