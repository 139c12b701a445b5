"""Citations as windows and joins over tokens, against a sequential reader."""

import random
import time

from corrobora.operators.citations import article_tokens, extract_citations
from tests.sequential_citations import collect

LINKS = ["https://a.example/p", "https://en.wikipedia.org/wiki/X", "https://web.archive.org/web/1/https://c.example/", "https://archive.is/q", "./Local", "#CITEREFA", "#CITEREFB", "#CITEREFgone"]


def page(rng):
    def ref():
        n = rng.randrange(6)
        name = rng.choice([f' id="r{rng.randrange(99)}"', ""])
        more = f'<a href="#n{rng.randrange(6)}">[{n}b]</a>' if rng.random() < 0.1 else ""
        return f'<sup{name} class="x reference"><a href="{rng.choice(["./T", ""])}#n{n}">[{n}]</a>{more}</sup>'

    def words():
        return " ".join(rng.choice(["alpha", "beta", "gamma,", "[vague]", "[3]", "\xa0", "délta"]) for _ in range(rng.randrange(7)))

    def block(depth):
        inside = "".join(rng.choice([words, ref, ref, lambda: rng.choice([" ", ", "]), lambda: block(depth + 1) if depth < 3 else ""])() for _ in range(rng.randrange(1, 8)))
        tag = rng.choice(["p", "div", "li", "span", "section", "td"])
        return f"<{tag}>{inside}</{tag}>" if rng.random() < 0.9 else f"<{tag}>{inside}"

    notes = "".join(f'<li id="n{i}">{rng.choice(["", "p. 7 ", "pp.\xa012"])}{"".join(f"<a href={x!r}>l</a>" for x in rng.sample(LINKS, rng.randrange(4)))}</li>' for i in range(5))
    full = '<li><cite id="CITEREFA">A</cite> <a href="https://x.example/a">f</a></li><li><cite id="CITEREFB"><a href="https://x.example/b">f</a></cite></li>'
    return "".join(rng.choice([lambda: f"<h2>{words()}</h2>", lambda: block(0)])() for _ in range(rng.randrange(6))) + f"<ol>{notes}{full}</ol>"


def test_against_the_sequential_reader(spark):
    rng = random.Random(7)
    pages = [page(rng) for _ in range(150)]
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(pages)] + [(None, None)], "doc_id long, html string").repartition(4)
    got = {}
    for r in extract_citations(frame).collect():
        got.setdefault(int(r["doc_id"]), []).append(r.asDict())
    total = nested = 0
    for i, html in enumerate(pages):
        want = collect(html)
        mine = sorted(got.get(i, []), key=lambda r: r["pos"])
        plain = ("pos", "ref_id", "citation_number", "claim_text", "url", "page_num", "section", "occurrence", "total_occurrences")
        single = all(not (t["kind"] == "place" and not t["own"]) for t in article_tokens(html))
        nested += not single
        if single:  # the sequential reader takes claims and runs of nested containers by the order in which it meets them
            plain = (*plain, "group_id", "group_size", "group_index", "group_citation_numbers")
            assert [[r[c] for c in plain] for r in mine] == [[r.get(c) for c in plain] for r in want], html
        total += len(mine)
    assert total > 300 and nested < 140


def test_nested_containers(spark):
    ref = lambda n: f'<sup id="r{n}" class="reference"><a href="#n">[{n}]</a></sup>'
    html = f"<div>A claim in the outer box{ref(1)} <p>and a claim of the inner one{ref(2)}</p>{ref(3)} <p>a third claim that stands alone{ref(4)}</p></div>"
    rows = sorted(extract_citations(spark.createDataFrame([(1, html)], "doc_id long, html string")).collect(), key=lambda r: r["pos"])
    assert [(r["citation_number"], r["claim_text"], r["group_id"], r["group_size"], r["group_index"]) for r in rows] == [
        ("1", "A claim in the outer box", "r1", 1, 0), ("2", "and a claim of the inner one", "r2", 2, 0), ("3", "and a claim of the inner one", "r2", 2, 1), ("4", "a third claim that stands alone", "r4", 1, 0)]


def test_repeated_ids_and_review_containers(spark):
    html = '<table><tr><th>Head</th><td>A cell with a claim<sup class="reference"><a href="#n">[1]</a></sup></td></tr></table><dl><dd><p>One more claim in a list<sup class="reference"><a href="#n">[1]</a></sup> here.</p></dd></dl>'
    rows = extract_citations(spark.createDataFrame([(1, html), (1, html)], "doc_id long, html string")).collect()
    assert sorted((r["pos"], r["occurrence"], r["total_occurrences"], r["container_text"]) for r in rows) == [(0, 1, 2, "A cell with a claim[1]")] * 2 + [(1, 2, 2, "One more claim in a list[1] here.")] * 2


def test_time_grows_with_the_article(spark):
    def took(n):
        html = "<div>" + "".join(f'<p>A claim that is long enough {i}<sup class="reference"><a href="#n{i}">[{i}]</a></sup></p>' for i in range(n)) + "<ol>" + "".join(f'<li id="n{i}"><a href="https://a.example/{i}">x</a></li>' for i in range(n)) + "</ol></div>"
        start = time.perf_counter()
        assert sum(t["kind"] == "note" for t in article_tokens(html)) == n
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 8 * 4 * took(4_000)


def test_texts_of_containers_are_left_out_of_what_is_shuffled(spark):
    """Citations are the same with and without them, and none is written with the claims."""
    from corrobora.operators.citations import cited, tokens

    html = '<p>One claim that is long enough<sup id="r" class="reference"><a href="#n">[1]</a></sup><sup id="s" class="reference"><a href="#n">[2]</a></sup></p><ol><li id="n"><a href="https://a.example/">a</a></li></ol>'
    frame = spark.createDataFrame([("a", html), ("b", html + html)], "doc_id string, html string")
    whole, bare = extract_citations(frame), extract_citations(frame, containers=False)
    assert "container_text" in whole.columns and "container_text" not in bare.columns and bare.count() == 6
    assert sorted(map(str, whole.drop("container_text").collect())) == sorted(map(str, bare.collect()))
    assert "container" not in cited(tokens(frame)).columns


def test_an_article_s_text_is_shuffled_once(spark):
    """Bytes shuffled stay near the text's own, however many windows and joins there are."""
    rng = random.Random(3)
    claim = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1500))
    two = lambda i: "".join(f'<sup id="{x}{i}" class="reference"><a href="#n">[{i}]</a></sup>' for x in "rs")
    pages = [(d, "".join(f"<p>{claim()}{two(i)}</p>" for i in range(40))) for d in range(8)]
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    args = (None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)

    def shuffled():
        found = store.stageList(*args)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        rows = extract_citations(spark.createDataFrame(pages, "doc_id long, html string").repartition(2), containers=False)
        between = shuffled()  # the articles themselves were dealt out
        rows.write.format("noop").mode("overwrite").save()
        spent = shuffled() - between
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert between > before and rows.count() == 640
    assert spent < 1.5 * 8 * 40 * 1500


def test_brackets_white_space_and_empty_references(spark):
    """Claims that cleaning leaves short take their container's text; an empty reference at the start is a run of its own."""
    ref = lambda n, text="": f'<sup id="r{n}" class="reference"><a href="#n">{text}</a></sup>'
    html = (
        f"<p>{ref(1)}A claim after an empty one{ref(2, '[2]')}</p><p>[1234567890123][citation needed] short{ref(3, '[3]')} but its container is long</p>"
        f"<p>  x y 　 z{ref(4, '[4]')}</p><p>(a) ten cha{ref(5, '[5]')}</p><p>[note one] and [vague] more{ref(6, '[6]')}</p>"
    )
    rows = sorted(extract_citations(spark.createDataFrame([(1, html)], "doc_id long, html string")).collect(), key=lambda r: r["pos"])
    assert [(r["citation_number"], r["claim_text"], r["group_id"], r["group_size"]) for r in rows] == [
        ("", "A claim after an empty one", "r1", 1), ("2", "A claim after an empty one", "r2", 1), ("3", "short but its container is long", "r3", 1),
        ("5", "(a) ten cha", "r5", 1), ("6", "[note one] and more", "r6", 1)]
