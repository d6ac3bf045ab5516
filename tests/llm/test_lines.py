import math
from collections import Counter, defaultdict

import odd

from graphlog.llm import lines

BLANKS = " \t\r\f\v"


def plain(data, percent):
    pages, seen = Counter(r[3] for r in data if r[3] is not None), defaultdict(Counter)
    for r in data:
        if r[3] is not None and r[1] is not None:
            seen[r[3]].update({x.strip(BLANKS) for x in r[1].split("\n")} - {""})
    bad = {h: {x for x, n in c.items() if n * 100 > pages[h] * percent + (100 - percent) * math.sqrt(pages[h])} for h, c in seen.items()}
    out = []
    for r in data:
        cut = bad.get(r[3], set())
        text = r[1] if r[1] is None or not cut else "\n".join(x for x in r[1].split("\n") if x.strip(BLANKS) not in cut)
        n = sum(1 for x in (r[1] or "").split("\n") if x.strip(BLANKS))
        out.append((r[0], text, r[3], n, n - sum(1 for x in (text or "").split("\n") if x.strip(BLANKS))))
    return odd.ordered(out)


def data():
    rows = odd.rows()
    more = [(100 + i, f"own line {i}\n  menu \nmore {i}\n\nfooter\r", "en", "a" if i % 2 else "b", 1) for i in range(30)]
    more += [(200 + i, f"menu\nmenu\n{i}", "en", "c", 1) for i in range(6)] + [(300, "menu\nfooter", "en", None, 1), (301, "menu", "en", "c", 1)]
    return rows + more


def test_equals_a_plain_version(spark):
    rows = data()
    for percent in (5, 50, 0):
        done = lines.drop_boilerplate(odd.frame(spark, rows), "source", "text", percent, "n_lines", "n_dropped")
        assert odd.ordered(done.select("doc_id", "text", "source", "n_lines", "n_dropped").collect()) == plain(rows, percent)


def test_frequencies_are_relative_to_the_site(spark):
    rows = [(i, f"shared\n{i}", "en", "small" if i < 10 else "large", 1) for i in range(400)]
    rows = [r if r[3] == "small" or r[0] % 40 == 0 else (r[0], f"only {r[0]}", *r[2:]) for r in rows]
    done = {r.doc_id: r.text for r in lines.drop_boilerplate(odd.frame(spark, rows), "source", "text").collect()}
    assert done[3] == "3" and done[40] == "shared\n40"


def test_clashing_names_and_empty_tables(spark):
    df = odd.clashing(odd.frame(spark, data()), ["_site", "_bad", "host", "lines"])
    assert lines.drop_boilerplate(df, "source", "text").columns == df.columns
    assert lines.drop_boilerplate(odd.frame(spark, []), "source", "text").count() == 0


def test_copies_of_a_page_can_count_as_one_page(spark):
    rows = [(i, f"menu\nown {i}", "en", "a", 1) for i in range(20)]
    rows += [(100 + i, "menu\ngiven\noften", "en", "a", 1) for i in range(30)] + [(200, None, "en", "a", 1), (201, "", "en", "a", 1)]
    done = {r.doc_id: r.text for r in lines.drop_boilerplate(odd.frame(spark, rows), "source", "text", copies=False).collect()}
    assert done[3] == "own 3" and done[110] == "given\noften" and done[200] is None and done[201] == ""
    sites = [(i, f"{i // 10}", "en", "s", 1) for i in range(300)]
    kept = lines.drop_boilerplate(odd.frame(spark, sites), "source", "text", 2, copies=False)
    assert all(r.text for r in kept.collect())


def test_the_ratio_alone_decides_on_small_sites(spark):
    def shares(site, pages, held):  # a line on some of a site's pages
        return [(i, f"menu\nown {site} {i}" if i < held else f"own {site} {i}", "en", site, 1) for i in range(pages)]

    sites = {"one": (1, 1), "both": (2, 2), "most of five": (5, 3), "two of five": (5, 2), "two of nine": (9, 2), "four of nine": (9, 4)}
    rows = [r for name, (pages, held) in sites.items() for r in shares(name, pages, held)]
    done = lines.drop_boilerplate(odd.frame(spark, rows), "source", "text").collect()
    assert {r.source for r in done if "menu" in r.text} == {"one", "two of five", "two of nine"}
