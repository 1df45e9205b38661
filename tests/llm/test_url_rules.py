from __future__ import annotations

import random
import re

from rows import by_id

from haberdash.llm import url_rules


def pages(spark, urls, ids=None):
    rows = list(zip(range(len(urls)) if ids is None else ids, urls, ["<p>"] * len(urls), ["x"] * len(urls)))
    return spark.createDataFrame(rows, "page_id long, url string, html string, template string")


def test_host_and_path_and_rules(spark):
    expected = {
        "http://A.Example.ORG/es/x?q=/": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/27#a": ("example.org", "/en/27", "org/", "allow"),
        "http://org/": ("org", "/", "org/", "allow"),
        "http://borg/": ("borg", "/", None, None),
        "http://x.org": ("x.org", "", None, None),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/de": ("x.com", "/de", None, None),
        "x.org/no/scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "http://ÉX.org/é": ("Éx.org", "/é", "org/", "allow"),
        "http://x.org\n/a": ("x.org\n", "/a", None, None),
    }
    found = by_id(url_rules.judge(pages(spark, list(expected))), "page_id")
    for n, (url, (host, path, rule, verdict)) in enumerate(expected.items()):
        row = found[n]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), url
        assert row["verdict"] in ("allow", "block") and verdict in (None, row["verdict"])


def test_templates_learn_from_labels(spark):
    urls = [f"http://site.com/de/{i}" for i in range(30)] + [f"http://site.com/fr/{i}" for i in range(30)]
    urls += [f"http://other.net/de/{i}" for i in range(5)] + [f"http://other.net/fr/{i}" for i in range(5)]
    found = by_id(url_rules.judge(pages(spark, urls)), "page_id")
    assert {found[i]["verdict"] for i in range(60, 65)} == {"block"}
    assert {found[i]["verdict"] for i in range(65, 70)} == {"allow"}
    assert found[60]["template"] == "/de/{n}"


def test_variable_segments_become_a_wildcard(spark):
    urls = [f"http://site.net/user/{''.join(chr(97 + (i * 7 + j * 3) % 26) for j in range(6))}/home" for i in range(26)]
    found = by_id(url_rules.judge(pages(spark, urls)), "page_id")
    assert {r["template"] for r in found.values()} == {"/user/*/home"}


def test_rows_are_kept(spark):
    frame = pages(spark, ["http://a.net/x", "http://a.net/x", None, "http://a.net/x"], [1, 1, None, None])
    assert url_rules.judge(frame).count() == 4
    assert url_rules.judge(frame.limit(0)).count() == 0


def test_paths_of_any_depth(spark):
    found = by_id(url_rules.judge(pages(spark, ["http://a.net/" + "a/" * 20_000, "http://a.net/" + "a/" * 19_999 + "b"])), "page_id")
    assert found[0]["template"] == "/a" * 20_000 + "/" and found[1]["template"] == "/a" * 19_999 + "/b"
    # Labels tell the branches apart only at the seventh segment, and a wildcard stands at the eighth.
    deep = [f"http://{host}/1/2/3/4/5/6/{part}/{'abcdefghijkl'[i]}/end" for host in ("x.com",) for part in ("p", "q") for i in range(12)]
    found = by_id(url_rules.judge(pages(spark, deep)), "page_id")
    assert {r["template"] for r in found.values()} == {f"/{{n}}/{{n}}/{{n}}/{{n}}/{{n}}/{{n}}/{p}/*/end" for p in "pq"}


def test_ended_paths_are_written_when_rounds_are_many(spark, monkeypatch):
    urls = ["http://a.net" + "/a" * n for n in range(6)]
    plain = by_id(url_rules.judge(pages(spark, urls)), "page_id")
    monkeypatch.setattr(url_rules, "MAX_PARTS", 2)
    assert by_id(url_rules.judge(pages(spark, urls)), "page_id") == plain
    assert [plain[n]["template"] for n in range(6)] == ["/a" * n for n in range(6)]


def plain_templates(rows):
    """Templates of {(host, path): (pages, labelled, blocked)}, node by node."""
    out, nodes = {}, {}
    for (host, path), sums in rows.items():
        rest = [re.sub("[0-9]+", "{n}", s) for s in path.split("/")[1:]]
        nodes.setdefault((host, ""), []).append((path, rest, sums))
    while nodes:
        following = {}
        for (host, template), members in nodes.items():
            children = {}
            for member in members:
                if member[1]:
                    children.setdefault(member[1][0], []).append(member)
                else:
                    out[host, member[0]] = template
            total = [sum(m[2][i] for c in children.values() for m in c) for i in range(3)]
            for child, own in children.items():
                labelled, blocked = (sum(m[2][i] for m in own) for i in (1, 2))
                step = child
                if len(children) >= url_rules.CHILDREN and total[0] < url_rules.REPEATS * len(children):
                    step = "*"
                elif len(children) > 1 and labelled:
                    pool = total[2] / total[1]
                    if abs(blocked / labelled - pool) <= url_rules.Z * (pool * (1 - pool) / labelled) ** 0.5:
                        step = "~"
                key = (host, f"{template}/{step}")
                following.setdefault(key, []).extend((p, rest[1:], s) for p, rest, s in own)
        nodes = following
    return out


def test_templates_equal_a_plain_tree(spark):
    rng = random.Random(11)
    rows = {}
    for _ in range(1500):
        path = "".join("/" + rng.choice(["a", "b", "c7", "", "c", f"w{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randrange(9)))
        pages_n = rng.randrange(1, 4)
        labelled = rng.choice([0, pages_n])
        rows[rng.choice(["x", "y"]), path] = (pages_n, labelled, labelled if "/b" in path or rng.random() < 0.1 else 0)
    for name in sorted({"".join(rng.choices("abcdefgh", k=5)) for _ in range(40)}):
        rows["z", f"/user/{name}" + rng.choice(["", "/x", "/y/1", "/y/b"])] = (1, 0, 0)
    frame = spark.createDataFrame(
        [(h, p, *sums) for (h, p), sums in rows.items()], "host string, path string, pages long, labelled long, blocked long"
    )
    found = {(r["host"], r["path"]): r["template"] for r in url_rules.templates(frame).collect()}
    assert found == plain_templates(rows)
    assert {"*", "~"} <= {part for t in found.values() for part in t.split("/")}
