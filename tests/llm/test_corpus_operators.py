from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from belltower.llm import decontaminate, graph, html_text, jaccard, line_dedup, sharding
from tests.llm.helpers import BASE, HARD, documents


def components_of(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(30)] + [(200, k) for k in range(201, 230)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return components_of(sets, links), sets


def near_rows():
    rng = random.Random(11)
    rows, words = [], [f"v{k}" for k in range(400)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(6, 90))]
        for _ in range(rng.randint(1, 14)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(1000, None), (1001, ""), (1002, "solo"), (1003, "SOLO")]


def test_jaccard_join_equals_brute_force(spark):
    rows = near_rows()
    want, sets = brute_components(rows)
    out = jaccard.query(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (len(sets[i]), want[i]) for i, _ in rows}


def test_jaccard_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    rows = near_rows()
    want, _ = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.query(documents(spark, rows)).collect()} == want


def test_jaccard_null_ids_link_and_bridge(spark):
    rng = random.Random(4)
    base = [rng.choice([f"v{k}" for k in range(400)]) for _ in range(100)]
    changed = [base[:at] + ["x"] * 3 + base[at + 3 :] for at in (20, 60)]
    rows = [(5, " ".join(base)), (None, " ".join(changed[0])), (7, " ".join(changed[0][:60] + ["y"] * 3 + changed[0][63:]))]
    sets = [shingle_set(t) for _, t in rows]
    linked = [100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in ((0, 1), (1, 2), (0, 2))]
    assert linked == [True, True, False]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.query(documents(spark, rows)).collect()} == {5: 5, None: 5, 7: 5}
    assert [r["doc_id"] for r in jaccard.one_of_each(documents(spark, rows)).collect()] == [5]


def test_jaccard_large_family_and_long_chain(spark):
    rng = random.Random(14)
    word = lambda: f"q{rng.randrange(3000)}"
    base = [word() for _ in range(80)]
    rows = [(k, " ".join(base[:at] + [word()] + base[at + 1 :])) for k, at in enumerate(rng.randrange(80) for _ in range(400))]
    now = [word() for _ in range(60)]
    for k in range(60):
        rows.append((1000 + k, " ".join(now)))
        now[rng.randrange(60)] = word()
    rows.append((2000, " ".join(base)))
    want, _ = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.query(documents(spark, rows)).collect()} == want


def test_jaccard_hard_rows(spark):
    out = jaccard.query(documents(spark, HARD))
    assert out.count() == len(HARD)
    ids = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert ids[3] == ids[4] == ids[5] == ids[None] == 3 and ids[1] == 1 and ids[2] == 2
    kept = jaccard.one_of_each(documents(spark, HARD))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(documents(spark, [*HARD, (3, BASE), (20, None), (20, None)])).collect()) == [1, 2, 3, 6, 7, 8, 9, 10, 20, 20]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6, 7, 8, 9, 10]
    assert jaccard.query(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=25), min_size=2, max_size=40))
def test_signature_trees_find_what_connects(lists):
    sets = [np.unique(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in lists]
    got = jaccard.group_links(np.arange(len(sets)), sets, np.zeros(len(sets), int), np.arange(len(sets)))
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    assert components_of(range(len(sets)), got) == components_of(range(len(sets)), links)
    assert all(tuple(sorted(x)) in links for x in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, limit):
    assert line_dedup.edit_distance_within(a, b, limit) == (distance(a, b) <= limit)


def line_rows():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = "".join(rng.choice("ab ") for _ in range(rng.choice((5, 11, 12, 13, 23, 24, 30)))) if rng.random() < 0.3 else f"a common line of the corpus number {rng.randint(0, 6)} which is long"
            for _ in range(rng.randint(0, 2)):
                p = rng.randrange(len(x))
                x = x[:p] + rng.choice(["", "z", x[p] + "y"]) + x[p + 1 :]
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    long = [f"v{rng.randint(0, 99)}" for _ in range(33)]
    for i in range(60, 95):
        now = long[: rng.choice((31, 32, 33))] + long[: rng.choice((0, 0, 2))]
        for _ in range(rng.randint(0, 3)):
            now[rng.randrange(len(now))] = rng.choice(["", "another", "two words"])
        rows.append((i, " ".join(" ".join(now).split())))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, "  " + rows[1][1])]


def brute_lines(rows):
    seen = [(i, k, x) for i, t in rows for k, x in enumerate(line_dedup.lines_of(t or "")) if x]
    distinct = sorted({x for _, _, x in seen})
    def near(a, b):
        v, w, n = a.split(), b.split(), min(len(a), len(b))
        by_words = min(len(v), len(w)) >= 32 and abs(len(v) - len(w)) <= 2 and distance(v, w) <= 2
        edits = 0 if n < 12 else 1 if n < 24 else 2
        return by_words or max(len(v), len(w)) < 34 and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits

    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if near(a, b)]
    of = components_of(distinct, links)
    groups = {}
    for i, k, x in seen:
        groups.setdefault(of[x], []).append((i, k))
    return {(i, k): min(groups[of[x]])[0] for i, k, x in seen if min(groups[of[x]]) != (i, k)}, seen


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    rows = line_rows()
    gone, seen = brute_lines(rows)
    for block in (1000, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        out = {r["doc_id"]: r for r in line_dedup.query(documents(spark, rows)).collect()}
        for i, _ in rows:
            want = ",".join(f"{k}:{lead}" for (d, k), lead in sorted(gone.items()) if d == i)
            assert (out[i]["duplicates"], out[i]["n_lines"]) == (want, sum(d == i for d, _, _ in seen))
            led = [x.split("=") for x in out[i]["classes"].split(",") if x]
            assert all((int(of.split(":")[0]) == gone[i, int(k)]) if (i, int(k)) in gone else of == f"{i}:{k}" for k, of in led)
    kept = {r["doc_id"]: r for r in line_dedup.without_duplicates(documents(spark, rows)).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert kept[i]["text"] == want and kept[i]["n_chars"] == (None if t is None else len(want))


def test_line_dedup_hard_rows(spark):
    assert line_dedup.query(documents(spark, HARD)).count() == len(HARD)
    assert line_dedup.query(documents(spark, [])).count() == 0
    assert line_dedup.without_duplicates(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "one line of some length here\nand more of it"), (2, "one line of some length here\nother things")]).selectExpr("*", "1 AS __row", "2 AS __gone", "3 AS lead", "4 AS class", "5 AS line", "6 AS leads")
    out = line_dedup.without_duplicates(clash)
    assert out.columns == clash.columns and {r["doc_id"]: (r["text"], r["__gone"]) for r in out.collect()} == {1: ("one line of some length here\nand more of it", 2), 2: ("other things", 2)}


def words_of(t):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_contamination(rows, items):
    out = []
    for i, t in rows:
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            q = words_of(text)
            n = min(10, len(q))
            wins = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(found)))
    return out


def test_decontamination_equals_brute_force(spark):
    items = [(1, BASE), (2, "Quick brown"), (3, None), (4, ""), (10, BASE + " again"), (5, "É ñ"), (6, "the the the the the the the the the the the"), (None, "nothing of the kind")]
    rows = [*HARD, (30, "prefix " + " ".join(BASE.split()[3:16]) + " suffix quick, BROWN!"), (31, "the " * 14), (32, "nothing of the kind here at all")]
    d = documents(spark, rows)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS word")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.query(d, b).collect()]
    key = lambda x: (x[0] is None, *map(lambda v: v or 0, x))
    assert sorted(got, key=key) == sorted(brute_contamination(rows, items), key=key)
    clean = decontaminate.clean_only(d, b)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 6, 7, 9}
    clash = d.selectExpr("*", "true AS contaminated", "1 AS n_words", "2 AS starts", "3 AS __row", "4 AS hit_items")
    assert {r["doc_id"] for r in decontaminate.clean_only(clash, b).collect()} == {1, 2, 6, 7, 9} and decontaminate.query(clash, b).count() == len(rows)
    assert decontaminate.query(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.query(documents(spark, []), b).count() == 0


def test_proximity_finds_shifted_anchors(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = documents(spark, [(1, item), (2, item.replace("beta", "beta extra")), (3, "alpha something else kappa")])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, items, tolerance=2).collect()} >= {1, 2}


def test_html_tags_are_read_once_and_contents_summed_only_where_asked_for(monkeypatch):
    page = "<body><div class=y>" + "<p class='a 1' hidden>x</p><p class='a 1'>y  z</p>" * 50 + f"<b class='{'l' * 300}'>w</b></div></body>"
    read, summed, find = [], [], html_text.ATTRIBUTE.findall

    class Attributes:
        findall = staticmethod(lambda text: read.append(text) or find(text))

    html_text.told_again.cache_clear()
    monkeypatch.setattr(html_text, "ATTRIBUTE", Attributes)
    monkeypatch.setattr(html_text, "summed", lambda nodes, f=html_text.summed: summed.append(1) or f(nodes))
    nodes = html_text.parse(page)
    assert len(read) == 4 and sum(n.doubted for n in nodes) == 50 and {n.style for n in nodes if n.tag == "p"} == {"p.a 0"}
    html_text.parse(page)
    assert sum(len(x) > 200 for x in read) == 2 and len(read) == 5  # long tags aren't remembered
    summed.clear()
    main, low = nodes[2], next(n for n in nodes if n.tag == "b")
    assert html_text.blocks(page, {main.path}, set())[-1] == "w" and not summed
    assert "w" not in html_text.blocks(page, {main.path}, {(low.path, low.content)}) and summed == [1]
    assert html_text.blocks(page, {1}, set()) and summed == [1, 1]  # judged by its own characters


def test_html_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>"</script></head><body>
<header>Head</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy</div><aside>Side</aside>
<article><h1>Title &amp;  more</h1><p>One<br>two</p><p>A <b>bold</b> word<p>Open &#233;<div class="comments">No</div></article><form>F</form><footer>Foot</footer></body></html>"""
    loose = "<html><body><div class=menu>m</div><div id='content'><p>Body text</p></div>"
    pages = spark.createDataFrame([(1, "http://a.example/x", page, "h"), (2, None, loose, "h"), (3, "http://a.example/y", None, None), (4, "http://a.example/z", "", "p"), (5, "bad", "plain & text <", "p"), (5, "bad", "plain & text <", "p")], "page_id long, url string, html string, host string")
    out = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    assert out[1]["text"] == "Title & more\nOne\ntwo\nA bold word\nOpen é"
    assert out[2]["text"] == "Body text" and out[3]["text"] == out[4]["text"] == "" and out[5]["text"].startswith("plain & text")
    assert out[1]["n_chars"] == len(out[1]["text"]) and html_text.main_text(pages).count() == 6
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_style_tree_drops_what_looks_and_reads_alike(spark):
    pages = [(k, f"http://h.example/{k}", f"<html><body><div class=x><p>Same words everywhere</p></div><div class=y><p>Own words {k} of page {k * 7}</p><p>More {k}</p></div></body></html>") for k in range(30)]
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Own words {r['page_id']} of page {r['page_id'] * 7}\nMore {r['page_id']}" for r in out)


def test_copies_on_a_host_cost_no_text(spark):
    def page(k, tag, same=7):
        return f"<html><body><div class=ad>Buy {k}</div><div class=x><p>Same words everywhere</p></div><{tag} class=y>" + "".join(f"<p>Part {i} of {0 if i < same else k}</p>" for i in range(7)) + f"</{tag}></body></html>"

    def text(k, same=7):
        return "\n".join(f"Part {i} of {0 if i < same else k}" for i in range(7))

    rows = [(k, f"http://{tag}.example/{k}", page(k, tag, 7 if k < 1000 else 0)) for tag in ("article", "div") for k in range(1040)]
    rows += [(k, "http://all.example/", page(0, "div")) for k in range(300)]
    # near copies: what only one page has stays, on distinct pages everything
    rows += [(k, "http://near.example/", page(k, "section", 6 if k < 1000 else 0)) for k in range(1, 1040)]
    out = {(r["url"].split("/")[2].split(".")[0], r["page_id"]): r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out["article", k] == text(k, 7 if k < 1000 else 0) for k in range(1040))
    assert all(out["div", k] == text(k, 7 if k < 1000 else 0) for k in range(1040))
    assert all(text(0) in out["all", k] for k in range(300))
    assert all(text(k, 0) == out["near", k] for k in range(1000, 1040)) and all(f"Part 6 of {k}" in out["near", k] for k in range(1, 1000))


def brute_tree(pages):
    """(importance, share) by host and path, straight from the definition."""
    import math
    from collections import Counter, defaultdict
    hosts, usual, seen = defaultdict(dict), {}, defaultdict(set)
    for h, page in pages:
        key, nodes = html_text.observed(html_text.parse(page))
        if key not in seen[h]:
            seen[h].add(key)
            for node, look in nodes:
                x = hosts[h].setdefault(node.path, [Counter(), Counter(), 0])
                x[0][look] += 1
                x[1][node.content] += 1
                x[2] += node.chars

    def entropy(c):
        m = sum(c.values())
        return 1.0 if m < 2 else (math.log(m) - sum(n * math.log(n) for n in c.values()) / m) / math.log(m)

    def both(look, content):
        h = entropy(content) if any(k is not None for k in content) else 0.0
        return max(entropy(look), h), h

    for path in {p for x in hosts.values() for p in x}:
        have = [h for h in hosts if path in hosts[h]]
        g, h = both(sum((hosts[x][path][0] for x in have), Counter()), sum((hosts[x][path][1] for x in have), Counter()))
        usual[path] = g, h * sum(hosts[x][path][2] for x in have) / sum(max(hosts[x][0][2], 1) for x in have)
    out = {}
    for host, paths in hosts.items():
        for path, (look, content, chars) in paths.items():
            g, h = both(look, content)
            m, n = sum(look.values()), len(seen[host])
            out[host, path] = (m * g + 10 * usual[path][0]) / (m + 10), (n * h * chars / max(paths[0][2], 1) + 10 * usual[path][1]) / (n + 10)
    return out


def site_pages():
    rng = random.Random(6)
    rows = []
    for k in range(40):
        host = f"h{k % 3}.example"
        story = "".join(f"<p>{' '.join(f'w{rng.randrange(500)}' for _ in range(12))}</p>" for _ in range(4))
        rows.append((k, f"http://{host}/{k}", f"<html><body><div class=top>Menu of {host}</div><{'article' if k % 3 else 'div'} class=text>{story}<div class=x{k}>Write to us at {host}</div></{'article' if k % 3 else 'div'}><div class=foot>All rights {k}</div></body></html>", story))
    return rows


def test_style_tree_equals_brute_force(spark):
    rows = site_pages()
    pages = spark.createDataFrame([r[:3] for r in [*rows, rows[0]]], "page_id long, url string, html string")
    got = {(r["host"], r["path"]): (r["importance"], r["share"]) for r in html_text.style_tree(html_text.sightings(pages)).collect()}
    want = brute_tree([(u.split("/")[2], h) for _, u, h, _ in rows])
    assert set(got) == set(want) and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_importance_decides_also_inside_articles(spark):
    rows = site_pages()
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    want = {k: story.replace("<p>", "").replace("</p>", "\n").strip() for k, _, _, story in rows}
    assert out == want


def test_deep_and_hostile_pages(spark):
    rows = [(1, "u", "<div>" * 4000 + "deep text"), (2, "u", "<p>" + "<a <b " * 20_000), (3, "u", "</i>" * 20_000 + "x" + "<svg>" * 3000), (4, "u", "<ul>" + "<li>a</span>" * 9000), (5, "u", "<p>&#x1F600; &amp; &nosuch; " + "y" * 300_000)]
    out = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "deep text" and out[3].startswith("x") and out[4].count("a") == 9000 and out[5].endswith("y" * 300_000) and out[5].startswith("\U0001F600 & &nosuch;")


def test_parsing_takes_time_in_proportion_to_the_page():
    import time

    def took(page):
        began = time.perf_counter()
        html_text.parse(page)
        return time.perf_counter() - began

    for make in (lambda n: "<b>" * n + "<p></p>" * n, lambda n: "<li><ul>" + "<b>" * n + "<li></li>" * n, lambda n: "<table><tr><td>" + "<i>" * n + "<p><option>" * n):
        took(make(1000))
        assert took(make(16_000)) < 12 * took(make(4000)) + 0.2
    nodes = html_text.parse("<ul><li>a<b>x<li>b</ul><p>c<i>d<div>e<dl><dt>f<dd>g<dt>h")
    up = [(n.tag, nodes[n.up].tag if n.up >= 0 else "") for n in nodes[1:]]
    assert up == [("ul", "#root"), ("li", "ul"), ("b", "li"), ("li", "ul"), ("p", "#root"), ("i", "p"), ("div", "#root"), ("dl", "div"), ("dt", "dl"), ("dd", "dl"), ("dt", "dl")]


def test_shards_are_written_whole_beside_columns_that_clash(spark, tmp_path):
    rows = [(i, f"text {i % 9} " * (i % 5 + 1), "en", f"s{i % 3}", "mine", i, "x") for i in range(120)] + [(7, None, None, None, "mine", 1, "y"), (7, None, None, None, "mine", 2, "z"), (None, "no id", "en", "s", "mine", 3, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, slot int, __id string")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard_"}
    assert sorted(map(tuple, back.select(*docs.columns).collect()), key=str) == sorted(rows, key=str)
    assert back.select("shard_").distinct().count() == 4


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    rows = near_rows()[:60] + [(500, BASE + " one two three"), (501, "clean text " + " ".join(f"u{k}" for k in range(30))), (502, None), (503, "")]
    shared = "a line of licence terms that many of the documents repeat word by word"
    rows = [(i, t if not t or i % 4 else t + "\n" + shared[: rng.randint(len(shared) - 1, len(shared))] + f"\ntail {i}") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # one class of labels: nothing is rejected as toxic (the classifier has its own test)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    gone, _ = brute_lines(rows)
    assert gone
    rows = [(i, t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]
    of, sets = brute_components(rows)
    rows = [(i, t) for i, t in rows if not sets[i] or of[i] == i]
    hit = {i for i, _, n, _ in brute_contamination(rows, [(1, BASE)]) if n}
    assert hit == {500}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows if i not in hit}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["n_tokens"] for r in got} == want
