"""Hostile and very long inputs, and prefilters against what they filter for."""

import collections
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import common, digest, license_scan, merge_dropout, packing, pii, site_templates, telephony, token_counts

# 4

LOCAL = re.compile(r"(?<![\w+%\-.])[\w+%\-]+(?:(?:\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|\.)[\w+%\-]+)*\Z", re.I)
PARTS = ["jane", "doe", "dot", "DOT", "punto", ".", "..", "(dot)", "[ dot ]", "< Punkt >", " ", "  ", "\n", "+", "%", "-", "(", ")", "é", "at", "x", "1", " dot "]


def test_names_before_at_signs():
    """The backward walk finds what a search of the whole text before the sign finds."""
    rng = random.Random(0)
    for _ in range(30_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 10)))
        m = LOCAL.search(text)
        assert pii._local_begin(text, 0, len(text)) == (m.start() if m else -1), text


def test_long_names_are_found_whole():
    name = ".".join(["abcdefgh"] * 100)
    text = "to " + name.replace(".", " dot ") + " (at) mail dot example dot com!"
    assert pii.identifiers(text) == [("email", 3, len(text) - 1, name + "@mail.example.com")]


PIECES = (
    "jane doe example com io at (at) [ at ] < arroba > {chez} AT dot punkt (dot) Punto . , ; : = == @ - _ / \" ' + ( ) \n \t     ​ ­ "
    "token secret password passwd api_key api-key apikey AKIA ghp_ sk- eyJ abcdefghijkl ABCDEFGHIJKLMNOPQRST 0 1 12 345 5551234 415 192.168.0.1 10.0.0.1 fe80 fe:dc: GB82 DE44 WEST "
    "one two three null eins zwei drei vier fünf un deux quatre cinq oh zero NINE cuatro о а е ı ſ İ ² ¹ ４ ５ ٣ ٤ é ß 😀 ∙ 。 ‑"
).split(" ") + [" "]


def test_prefilter_lets_all_finds_pass():
    """Texts put together out of the patterns' own parts: the prefilter passes every text that identifiers finds anything in."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", ""]) for _ in range(rng.randint(1, 14))) for _ in range(40_000)]
    passed = set(pii._suspects(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])).tolist())
    missed = [t for i, t in enumerate(texts) if i not in passed and pii.identifiers(t)]
    assert missed == []
    assert sum(bool(pii.identifiers(t)) for t in texts[:4000]) > 200


LONG = {"a@": 1, "a": 2, "a.": 1, " at dot": 1, "1 ": 1, "one ": 1, "(": 1, "555-": 1, "jane (at) ": 1, "GB82 WEST ": 1, "fe:dc:": 1, " ": 2, "jane ( ": 1, "secret= ": 1, "4111 ": 1, "+1 ": 1, "jane@example.com, ": 1, "5​": 1, "a-": 1}


@pytest.mark.parametrize("unit", sorted(LONG))
def test_time_is_linear(unit):
    text = unit * (200_000 // len(unit))
    began = time.time()
    pii.identifiers("x" + text + "@y.z" * (LONG[unit] - 1))
    assert time.time() - began < 6


# 1

PUBLIC = os.path.exists(packing.MODEL)


@pytest.mark.skipif(not PUBLIC, reason="no public vocabularies")
def test_packed_texts(spark):
    """Pieces put together are the texts, each has the tokens it says and lies within a bin, however a text must be cut."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=packing.MODEL)
    rng = random.Random(2)
    texts = ["plain  words and\nmore ", "中文" * 300, "x" * 900, "", None, " ", "unbelievable " * 60, "😀" * 99, "a ▁ b " * 30, " lead", "é" * 150 + " " * 20 + "tail"]
    texts += ["".join(rng.choice(["ab ", "thing", " ", "中", "😀", "\n", "zq", "▁"]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c"), (0, "another text", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin_id string")
    got = packing.pack_texts(docs, capacities=(50, 8, 2000), shard_docs=20).collect()
    longest = packing.longest_piece((50, 8, 2000))
    bins, by = {}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
        by.setdefault(r.doc_id, []).append(r)
    for own in bins.values():
        assert sum(r.n_tokens for r in own) <= 50 and len(own) <= 8 and sum(r.n_tokens**2 for r in own) <= 2000
        assert sorted(r.position for r in own) == list(range(len(own)))
    for i, t in enumerate(texts):
        if i == 0 or not t:
            assert i == 0 or i not in by
            continue
        own = sorted(by[i], key=lambda r: r.piece)
        assert "".join(r.text for r in own) == t and all(0 < r.n_tokens <= longest for r in own)
        assert [r.first_token for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]
        if "▁" not in t:
            assert sum(r.n_tokens for r in own) == len(sp.encode(t))
    assert sorted(r.text for r in by[0]) == ["another text", texts[0], texts[0]] and [r.text for r in by[None]] == ["no id"]
    assert packing.pack_texts(docs.limit(0)).count() == 0
    again = packing.pack_texts(docs.repartition(5), capacities=(50, 8, 2000), shard_docs=20).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_ties_in_spark(spark):
    """Many equal lengths: bins are those of plain best fit over documents in order of length and id."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([3, 3, 3, 7, 7, 20, 45]))) for i in range(200)]
    cap, w = (60, 5, 2500), (1.0, 0.25, 0.5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.bin_id for r in packing.pack_documents(docs, capacities=cap, weights=w, shard_docs=1000).collect()}
    items = sorted(((len(t.split()), i) for i, t in rows), key=lambda x: (-x[0], x[1]))
    rooms, where = [], {}
    for n, i in items:
        best = None
        for k, room in enumerate(rooms):
            left = [r - d for r, d in zip(room, (n, 1, n * n))]
            if min(left) >= 0:
                score = sum(x * (y / c) ** 2 for x, y, c in zip(w, left, cap))
                if best is None or score < best[0] - 1e-12:
                    best = (score, k, left)
        if best is None:
            rooms.append([c - d for c, d in zip(cap, (n, 1, n * n))])
            where[i] = len(rooms) - 1
        else:
            rooms[best[1]], where[i] = best[2], best[1]
    assert got == where


# 10


def plain_agenda(v, unit, key, rate):
    """Candidates in the order of priority and place, rebuilt from nothing before each step."""
    symbols = [(v.character[ord(c)] if v.character[ord(c)] >= 0 else -1 - ord(c), i, i + 1) for i, c in enumerate(unit)]
    gone = set()
    while True:
        best = None
        for (s, a, m), (t, _, e) in zip(symbols, symbols[1:]):
            piece = v.pairs.get(int(s) * v.n + int(t)) if s >= 0 and t >= 0 else None
            if piece is not None and (a, m, e) not in gone and (best is None or (v.priority[piece], a) < best[0]):
                best = (v.priority[piece], a), a, m, e, piece
        if best is None:
            return merge_dropout._to_ids(v, [int(s) for s, _, _ in symbols])
        _, a, m, e, piece = best
        if merge_dropout.skipped(np.array([key], np.uint64), np.array([a]), np.array([m]), np.array([e]), rate)[0]:
            gone.add((a, m, e))
        else:
            k = next(k for k, x in enumerate(symbols) if x[1] == a)
            symbols[k : k + 2] = [(piece, a, e)]


@pytest.mark.skipif(not PUBLIC, reason="no public vocabularies")
@pytest.mark.parametrize("rate", [0.05, 0.1, 0.6, 1.0])
def test_trees_rows_and_heap_are_one_agenda(monkeypatch, rate):
    """Words met often (trees), rarely (side by side) and long ones (heap): each occurrence as a plain agenda gives it."""
    v, rng = merge_dropout.vocabulary(merge_dropout.MODEL), random.Random(1)
    words = ["the", "and", "of", "unbelievable", "internationalisation", "", "a▁b", "中文字", "naïve", "x" * 15, "thing", "  lead"]
    words += ["".join(rng.choice("abcdethonriesé你😀ß▁\n") for _ in range(rng.randint(1, 45))) for _ in range(60)]
    run = [rng.choice(words[: rng.choice([4, 12, len(words)])]) for _ in range(4000)]
    places = np.array([rng.getrandbits(64) for _ in run], np.uint64)
    for nodes in (1 << 20, 50):
        monkeypatch.setattr(merge_dropout, "MAX_NODES", nodes)
        encoder = merge_dropout.Encoder(v, 77, rate)
        ids, sizes = [], []
        for s in range(0, len(run), 700):
            part, size = encoder.encode(run[s : s + 700], places[s : s + 700])
            ids.append(part)
            sizes.append(size)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        ends = np.cumsum(sizes)
        if nodes > 50:
            assert encoder.trees.n > 50 and encoder.trees.roots
        for k, w in enumerate(run):
            key = int(common.mix64(np.array([merge_dropout.xxhash.xxh64_intdigest((" " + w).encode(), 77)], np.uint64) ^ places[k : k + 1])[0])
            assert ids[ends[k] - sizes[k] : ends[k]].astype(np.int32).tobytes() == plain_agenda(v, " " + w, key, rate), w


@pytest.mark.skipif(not PUBLIC, reason="no public vocabularies")
def test_long_text_without_blanks():
    v = merge_dropout.vocabulary(merge_dropout.MODEL)
    unit = " " + "中文字的数据处理" * 12_000
    began = time.time()
    got = merge_dropout.agenda(v, unit, 5, 0.1)
    assert time.time() - began < 15
    assert merge_dropout.decode_ids(v, np.frombuffer(merge_dropout._to_ids(v, got), np.int32)).tobytes().decode() == unit


# 3


@pytest.mark.parametrize("unit", ["<a ", "<", "<a '", '<a "', "<!", "<?", "<!-- ", "</a", "<a<", "<head>", "<script>", "<div>", "<div></span>", "<head ", "<p '\">", "<textarea", "&lt;", "</", "<a b='"])
def test_markup_takes_linear_time(unit):
    html = unit * (300_000 // len(unit))
    began = time.time()
    site_templates.parse(html)
    site_templates.text_of("<p>before</p>" + html)
    assert time.time() - began < 5


def test_broken_markup():
    assert site_templates.text_of("<p>one</p><p>two <a href='x>three</p><p>four</p>") == "one\ntwo three\nfour"
    assert site_templates.text_of("<p>1 < 2 and 3 > 2</p><b>x") == "1 < 2 and 3 > 2\nx"
    assert site_templates.text_of('<p title="a > b">quoted</p><!-- <p>no</p>') == "quoted"
    assert site_templates.text_of("<head><title>t</title></head><p>body</p><head>late") == "body\nlate"


def page_tree(rng, nav, side, words):
    body = [("nav", [("ul", [("li", [w]) for w in nav])])]
    if side:
        body.append(("aside", [("p", [side])]))
    body.append(("article", [("p", [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9)))]) for _ in range(rng.randint(1, 4))]))
    body.append(("footer", [("p", ["imprint"]), ("p", [f"page {rng.randint(0, 2)}"])]))
    return ("body", body)


def markup(node):
    return node if isinstance(node, str) else f"<{node[0]} class=c{len(node[1])}>" + "".join(map(markup, node[1])) + f"</{node[0]}>"


def test_templates_by_brute_force(spark):
    """Pages made from trees: subtrees (as nested tuples) in enough different articles go, the outermost first; the others' text is left, line by line."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["short", "words"]
    sites = {f"h{k}.org": ([f"menu{k}{i}" for i in range(3)], [f"box{k}{i}" for i in range(3)]) for k in range(4)}
    rows = []
    for host, (nav, boxes) in sites.items():
        for _ in range({"h0.org": 4, "h1.org": 9, "h2.org": 60, "h3.org": 400}[host]):
            rows.append((len(rows), host, page_tree(rng, nav, rng.choice([*boxes, *boxes, None, "once " + rng.choice(words)]), words)))
    rows += [(len(rows) + i, "h1.org", rows[5][2]) for i in range(7)]  # copies of one page are one content

    def subtrees(node):
        if not isinstance(node, str):
            yield repr(node)
            for child in node[1]:
                yield from subtrees(child)

    seen, contents = {}, {}
    for _, host, tree in rows:
        content = repr([x for x in tree[1] if x[0] == "article"])
        contents.setdefault(host, set()).add(content)
        for sub in subtrees(tree):
            seen.setdefault((host, sub), set()).add(content)

    def lines(host, node):
        if isinstance(node, str):
            return [node]
        if len(seen[host, repr(node)]) >= max(5, 0.25 * len(contents[host]) ** 0.5):
            return []
        return [x for child in node[1] for x in lines(host, child)]

    pages = spark.createDataFrame([(i, f"https://{host}/p", markup(tree)) for i, host, tree in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_templates.main_text(pages.repartition(6)).collect()}
    assert got == {i: "\n".join(lines(host, tree)) for i, host, tree in rows}
    assert any("box3" in t for t in got.values()) is False and any("menu0" in t for t in got.values())


# 8


def test_colliding_digests_are_told_apart(spark):
    """Equal digests with different bodies, as a broken hash would give, never join two documents."""
    rows = [(1, b"d", b"x"), (2, b"d", b"y"), (3, b"d", b"x"), (4, b"e", b"x"), (5, b"f", b"z"), (6, b"f", b"z"), (7, None, None), (None, b"d", b"y"), (None, b"g", b"q")]
    full = spark.createDataFrame([(i, d and bytearray(d), x and bytearray(x)) for i, d, x in rows], "doc_id long, digest binary, body binary")
    got = sorted(((r.doc_id, r.canonical_id, r.n_copies) for r in digest.groups(full.drop("body"), full).collect()), key=repr)
    assert got == sorted([(1, 1, 2), (3, 1, 2), (2, 2, 2), (None, 2, 2), (4, 4, 1), (5, 5, 2), (6, 5, 2), (7, 7, 1), (None, None, 1)], key=repr)


def test_hot_text(spark):
    rows = [(i, "The  SAME text" if i % 3 else "the same text") for i in range(3000)] + [(-5, "other")]
    got = digest.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
    assert sorted(map(tuple, got.select("canonical_id", "n_copies").distinct().collect())) == [(-5, 1), (0, 3000)]


# 2

TEMPLATES = (
    ("short", "use it as you like"),
    ("odd", "zebras may graze on these fields of text until further notice from the keeper"),
    ("long", " ".join(f"clause{i} says word{i % 7} and more{i % 11}" for i in range(300))),
    ("twin", "zebras may graze on these fields of text until further notice from the owner of it"),
    ("none", "..."),
)


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def spoiled(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        k = rng.randrange(len(words))
        kind = rng.choice("drop add swap".split())
        words[k : k + 1] = {"drop": [], "add": [words[k], "uncommon"], "swap": ["instead"]}[kind]
    return words


def test_any_template_is_found():
    """Templates without a usual word, of any length: planted notices within the limit are found where they stand, by whatever kind of change; others are not; nothing twice."""
    tools, rng = license_scan.Compressors(TEMPLATES), random.Random(4)
    plain = [t.split() for _, t in TEMPLATES[:4]]
    import zstandard

    met = collections.Counter()
    for trial in range(60):
        words, planted = [], []
        for _ in range(rng.randint(1, 5)):
            words += [rng.choice("the prose of a story keeper text may these on it".split()) for _ in range(rng.randint(0, 40))]
            i = rng.choice([0, 1, 1, 3, 2]) if trial % 6 == 0 else rng.choice([0, 1, 1, 3])
            limit = int(0.15 * len(plain[i]))
            changes = rng.choice([0, limit // 2, limit + 3])
            said = spoiled(rng, plain[i], changes)
            planted.append((i, len(words), said))
            words += said
        words += ["story"] * 3
        text = rng.choice([" ", "\n", "\n# ", "  *\n\n * "]).join(words)
        rows = license_scan.licences(text, tools)
        assert all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))
        for begin, end, name, alone, given, missing, extra, exact in rows:
            span = [w for w, _, _ in license_scan._words(text[begin:end])]
            template = next(p for p, (n, _) in zip(plain, TEMPLATES) if n == name)
            same = common_words(template, span)
            assert missing + extra <= 0.15 * len(template) and len(template) - same <= missing and given < alone
            assert exact == (span == template)
        places = [a for _, a, _ in license_scan._words(text)]
        for i, at, said in planted:
            same = common_words(plain[i], said)
            begin, end = places[at], places[at + len(said) - 1]
            hit = [r for r in rows if r[0] <= end and begin < r[1]]
            if len(plain[i]) + len(said) - 2 * same <= int(0.15 * len(plain[i])):
                met["within"] += 1
                assert len(hit) >= 1 and (hit[0][2] == TEMPLATES[i][0] or {hit[0][2], TEMPLATES[i][0]} == {"odd", "twin"}), (TEMPLATES[i][0], said)
            elif not hit:
                met["beyond"] += 1
    assert met["within"] > 60 and met["beyond"] > 5
    # ranks are those of plain calls
    block = "zebras may graze on these fields of text until further notice from the warden"
    plainly = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0))
    alone, ranked = tools.ranked(block)
    assert alone == len(plainly.compress(block.encode())) and ranked == sorted(ranked) and {TEMPLATES[i][0] for _, i in ranked[:2]} == {"odd", "twin"}


def test_scan_with_own_templates_by_brute_force(spark):
    """The prefilter passes all that the scan of every text finds."""
    rng = random.Random(3)
    tools = license_scan.Compressors(TEMPLATES)
    texts = [" ".join(spoiled(rng, TEMPLATES[rng.randrange(4)][1].upper().split(), rng.randint(0, 2))) if k % 3 else "plain text on fields may it" for k in range(60)] + [None, "", "use it as you liKe", "use it as you like"] * 2
    docs = spark.createDataFrame([(None if i == 5 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, licence int")
    want = sorted(((None if i == 5 else i, *row) for i, t in enumerate(texts) for row in license_scan.licences(t or "", tools)), key=repr)
    got = sorted((tuple(r) for r in license_scan.scan_licences(docs, TEMPLATES).collect()), key=repr)
    assert got == want and len({r[0] for r in got}) > 30


def test_many_notices_take_linear_time():
    tools = license_scan.Compressors(license_scan.TEMPLATES)
    began = time.time()
    assert len(license_scan.licences("Licensed under CC BY 4.0.\n" * 5000, tools)) == 5000
    assert len(license_scan.licences((license_scan._MIT + "\n\n") * 50, tools)) == 50
    assert license_scan.licences("the software license permission notice " * 8000, tools) == []
    assert time.time() - began < 30


# 5


def test_payloads_beyond_a_binary_value(spark, monkeypatch):
    payload = bytes(range(256)) * 3
    rows = [(1, "mulaw", bytearray(payload)), (2, "adpcm", bytearray(payload)), (3, "alaw", bytearray(payload[:99])), (4, None, bytearray(payload))]
    media = spark.createDataFrame(rows, "doc_id long, codec string, payload binary")
    whole = {r.doc_id: (r.n_samples, r.pcm and bytes(r.pcm)) for r in telephony.decode_calls(media).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([bytes(r[2]) for r in rows])], ["doc_id", "codec", "payload"])
    monkeypatch.setattr(telephony, "LARGEST", 1000)
    got = {r["doc_id"]: (r["n_samples"], r["pcm"]) for b in telephony._decode(iter([batch])) for r in b.to_pylist()}
    assert got == {1: (whole[1][0], None), 2: (whole[2][0], None), 3: whole[3], 4: (None, None)}


# 6


@pytest.mark.skipif(not PUBLIC, reason="no public vocabularies")
def test_equal_hashes_are_no_equal_pieces(monkeypatch):
    """With a hash under which all long pieces of a length look alike but one, counts are still those of plain dictionaries."""
    u = token_counts.Unigrams(merge_dropout.model_file(merge_dropout.MODEL))
    rng = random.Random(1)
    long = [p.decode() for p in u.scores if len(p) > 9][:300]
    words = list({rng.choice(long).lstrip("▁")[: rng.randint(5, 30)] + rng.choice(["", "s", "ing", rng.choice(long)]) for _ in range(500)})
    want = [token_counts.one_count(u, ("▁" + w).encode()) for w in words]
    assert token_counts.pre_token_counts(u, words) == want
    monkeypatch.setattr(token_counts, "_BASE", 0)  # the hash of a piece is that of its last byte
    for n, (keys, scores, pieces) in list(u.by_length.items()):
        if n > token_counts.EXACT:
            order = np.argsort(pieces[:, -1], kind="stable")
            last = pieces[order][:, -1].astype(np.uint64) + np.uint64(1)
            one = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
            u.by_length[n] = last[one], scores[order][one], pieces[order][one]
            for p in set(map(bytes, pieces)) - set(map(bytes, pieces[order][one])):
                del u.scores[p]
    assert token_counts.pre_token_counts(u, words) == [token_counts.one_count(u, ("▁" + w).encode()) for w in words]
