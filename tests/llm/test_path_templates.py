"""The path-template tree against a plain one, and sections at different depths."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import url_templates
from tallymart.llm.url_templates import DEPTH, EXACT, PURITY, SHAPES, SMOOTHING, TAIL, Z


def shape(segment):
    for pattern, name in SHAPES:
        if re.search(pattern, segment):
            return re.sub(pattern, name.replace("$1", r"\1"), segment)
    return segment.replace("{", "%7B").replace("}", "%7D")


def tail(good, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(good + 1))


def differs(good, n, p):
    if not n or not 0 < p < 1:
        return False
    if n > EXACT:
        return abs(good / n - p) > Z * math.sqrt(p * (1 - p) / n)
    return (tail(good, n, p) if good <= n * p else tail(n - good, n, 1 - p)) < TAIL


def wilson(good, n):
    s, spread = good / n, Z * Z / n
    half = Z / (1 + spread) * math.sqrt(s * (1 - s) / n + spread / (4 * n))
    return (s + spread / 2) / (1 + spread) - half, (s + spread / 2) / (1 + spread) + half


def plain_tree(paths):
    """{path: template} of one host's {path: (labelled, good)}."""
    out = {}

    def node(prefix, depth, rows):
        l, g = sum(r[2] for r in rows), sum(r[3] for r in rows)
        if all(r[1] == rows[0][1] for r in rows):
            rest, room = rows[0][1], max(0, DEPTH - depth)
            if g in (0, l) and len(rows) > 1 and len(rest) > room:
                rest = rest[:room] + ["{tail}"]
            for r in rows:
                out[r[0]] = "/".join([prefix, *rest])
            return
        groups = defaultdict(list)
        for r in rows:
            groups[r[1][0]].append(r)
        names, apart = {}, defaultdict(list)
        for branch, own in groups.items():
            bl, bg = sum(r[2] for r in own), sum(r[3] for r in own)
            if branch.startswith("{") or branch == "":
                names[branch] = branch
            elif l and differs(bg, bl, g / l) and len(groups) > 1:
                apart["low" if bg < bl * g / l else "high"].append((*wilson(bg, bl), bl, branch))
            else:
                names[branch] = "{any}" if len(groups) > 1 else branch
        for side, found in apart.items():
            islands, reach = [], -1.0
            for low, high, _, branch in sorted(found):
                if not islands or low > reach:
                    islands.append([])
                islands[-1].append(branch)
                reach = max(reach, high)
            for i, island in enumerate(islands, 1):
                for branch in island:
                    names[branch] = branch if len(island) == 1 else f"{{any:{side}{i}}}"
        joined = defaultdict(list)
        for r in rows:
            joined[names[r[1][0]]].append((r[0], r[1][1:], r[2], r[3]))
        for name, own in joined.items():
            ended = [r for r in own if not r[1]]
            for r in ended:
                out[r[0]] = f"{prefix}/{name}"
            if len(ended) < len(own):
                node(f"{prefix}/{name}", depth + 1, [r for r in own if r[1]])

    node("", 0, [(p, [shape(x) for x in p.removeprefix("/").split("/")], l, g) for p, (l, g) in paths.items()])
    return out


def judged(spark, urls):
    """Rows of (url, label) by place."""
    pages = spark.createDataFrame([(i, u, "clash") for i, (u, _) in enumerate(urls)], "page_id long, url string, purity string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "page_id long, good int")
    return {r.page_id: r for r in url_templates.judged(pages, labels, []).collect()}


def random_urls(seed):
    rng = np.random.default_rng(seed)
    words = ["news", "shop", "blog", "casino", "pills", "wiki", "{any}", "a b", "{number}", "ü", ""]
    urls = []
    for _ in range(1500):
        host = f"h{rng.integers(4)}.test"
        path = [str(words[k]) for k in rng.integers(0, len(words), rng.integers(1, 4))]
        path += [str(rng.integers(1000))] if rng.random() < 0.5 else ["2024-05-06"] if rng.random() < 0.2 else []
        path += ["x"] * int(rng.integers(0, 9)) if rng.random() < 0.3 else []
        bad = 0.9 if "casino" in path or "pills" in path else 0.1
        label = None if rng.random() < 0.3 else int(rng.random() >= bad)
        urls.append((f"http://{host}/{'/'.join(path)}", label))
    return urls + urls[:50] + [("http://only.test/" + "y/" * 300 + "end", 1), ("http://only.test/" + "y/" * 300 + "other/1", 0), (None, 1), ("no scheme", 0), ("http://root.test", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_tree_equals_a_plain_one(spark, seed):
    urls = random_urls(seed)
    found = judged(spark, urls)
    hosts = defaultdict(dict)
    for i, (_, label) in enumerate(urls):
        r = found[i]
        l, g = hosts[r.host].get(r.path, (0, 0))
        hosts[r.host][r.path] = (l + (label is not None), g + (label or 0))
    expected = {h: plain_tree(paths) for h, paths in hosts.items()}
    every = [c for paths in hosts.values() for c in paths.values()]
    overall = sum(g for _, g in every) / sum(l for l, _ in every)
    for h, paths in hosts.items():
        hl, hg = sum(l for l, _ in paths.values()), sum(g for _, g in paths.values())
        prior = (hg + SMOOTHING * overall) / (hl + SMOOTHING)
        sums = defaultdict(lambda: [0, 0])
        for p, (l, g) in paths.items():
            sums[expected[h][p]][0] += l
            sums[expected[h][p]][1] += g
        for r in found.values():
            if r.host == h:
                l, g = sums[expected[h][r.path]]
                assert r.template == expected[h][r.path], (h, r.path)
                assert r.purity == pytest.approx((g + SMOOTHING * prior) / (l + SMOOTHING))
                assert r.verdict == ("block" if r.purity < PURITY else "allow")
    assert len({r.template for r in found.values()}) > 40


def test_similar_branches_are_merged_with_each_other(spark):
    urls = [(f"http://h.test/{a}{b}/{i}", int(a == "a")) for a in "ab" for b in "abcd" for i in range(30)]
    found = judged(spark, urls)
    templates = {urls[i][0].split("/")[3][0]: r.template for i, r in found.items()}
    assert templates == {"a": "/{any:high1}/{number}", "b": "/{any:low1}/{number}"} and len({r.template for r in found.values()}) == 2
    assert all(found[i].verdict == ("allow" if good else "block") for i, (_, good) in enumerate(urls))


@pytest.mark.parametrize("above", ["x", "a/b/c/d/e/f", "a/b/c/d/e/f/g/h/i/j/k"])
def test_a_section_has_the_same_verdicts_at_every_depth(spark, above):
    urls = [(f"http://h.test/{above}/{i}", 0) for i in range(12)] + [(f"http://h.test/{above}/2024-01-{i + 10}", None) for i in range(12)]
    urls += [(f"http://other.test/{i}", 1) for i in range(400)]
    found = judged(spark, urls)
    assert {found[i].template for i in range(12)} == {f"/{above}/{{number}}"} and {found[i].template for i in range(12, 24)} == {f"/{above}/{{date}}"}
    dated = {found[i].verdict for i in range(12, 24)}
    assert {found[i].verdict for i in range(12)} == {"block"} and dated == {"block"}  # the host's other labels are all bad


def test_one_label_is_no_significant_difference(spark):
    urls = [(f"http://h.test/s{chr(97 + k % 26)}{chr(97 + k // 26)}/p", int(k != 5)) for k in range(20)]
    found = judged(spark, urls)
    assert {r.template for r in found.values()} == {"/{any}/p"}


def test_no_literal_equals_a_wildcard(spark):
    urls = [("http://h.test/{any}/x", 0)] * 30 + [(f"http://h.test/s{chr(97 + k)}/x", 1) for k in range(26)] + [("http://h.test/{number}/x", 0)] * 30
    urls += [(f"http://h.test/{k}/x", 1) for k in range(30)]
    found = judged(spark, urls)
    assert found[0].template.startswith("/{any:low") or found[0].template == "/%7Bany%7D/x"
    assert found[0].template != found[30].template and found[56].template != found[86].template
    assert found[0].verdict == found[56].verdict == "block" and found[30].verdict == found[86].verdict == "allow"


def test_lower_tail_is_exact(spark):
    rows = [(g, n, p) for n in (1, 2, 7, 60) for g in range(0, n + 1, 3) for p in (0.001, 0.3, 0.5, 0.97)]
    df = spark.createDataFrame(rows, "g long, n long, p double")
    for r in df.select("*", url_templates._lower_tail(F.col("g"), F.col("n"), F.col("p")).alias("t")).collect():
        assert r.t == pytest.approx(tail(r.g, r.n, r.p), rel=1e-9)
