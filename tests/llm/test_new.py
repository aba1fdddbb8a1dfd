"""Vector codes, conversation repair and page text against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorset.llm import codebooks, dialogue, queries, webpages

SF_DIR = "/root/testdata/sf0.001"
CLASHES = "row id v position entry salt moved error c live tie part no page host stream names place".split()


def clashing(frame):
    return frame.select("*", *(F.lit("x").alias(c) for c in CLASHES if c not in frame.columns))


# --- vector codes --------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    """(vec_id, label, vector) rows to codes, errors and the digest, by loops."""
    kept = [(i, lab, [math.floor(1024 * float(x)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][2]) // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(4)]

    def nearest(p, part):
        far = ((np.array(books[p]) - np.array(part)) ** 2).sum(1).tolist()
        return far.index(min(far)), min(far)

    def parts(v):
        return [v[p * width : (p + 1) * width] for p in range(4)]

    for _ in range(rounds):
        held = [[[] for _ in books[p]] for p in range(4)]
        for _, _, v in kept:
            for p, part in enumerate(parts(v)):
                held[p][nearest(p, part)[0]].append(part)
        for p in range(4):
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for e, m in zip(books[p], held[p])]
    out = []
    for i, lab, v in kept:
        found = [nearest(p, part) for p, part in enumerate(parts(v))]
        out.append((i, lab, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    by_label = Counter()
    for _, lab, _, e in out:
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[lab]) for i, lab, c, e in out], digest


def vectors(n, seed=1, dims=8):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(3)) or None, [float(x) for x in rng.normal(size=dims).astype("float32")]) for i in range(n)]
    rows += [(5, 1, rows[5][2]), (5, 1, rows[5][2]), (7, 2, rows[9][2]), (None, None, rows[3][2]), (None, 2, None)]
    odd = [float("nan"), float("inf"), -float("inf"), None]
    return rows + [(1000 + k, 1, [x, *rows[0][2][1:]]) for k, x in enumerate(odd)] + [(-1, 1, [0.0] * dims)]


@pytest.mark.parametrize("n", [10, 600])
def test_codes_are_those_of_a_plain_loop(spark, n, tmp_path):
    rows = vectors(n)
    schema = "vec_id long, label int, embedding array<float>"
    clashing(spark.createDataFrame(rows, schema).repartition(5)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_codebooks(spark, str(tmp_path)).collect()
    want, digest = plain_codes(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_members_stay_with_their_owner(spark, monkeypatch):
    """Only parts that change their entry are dealt out again."""
    dealt = []
    plain = codebooks.Owners._dealt
    monkeypatch.setattr(codebooks.Owners, "_dealt", lambda self, rows: (dealt.append(rows.count()), plain(self, rows))[1])
    monkeypatch.setattr(codebooks, "OWNER_PARTS", 100)
    table = spark.createDataFrame(vectors(600), "vec_id long, label int, embedding array<float>")
    coded, books = codebooks.compressed(table)
    n = coded.count()
    assert dealt[0] == 4 * n and dealt[1:] == sorted(dealt[1:], reverse=True) and 0 < dealt[1] < 2 * n
    near = codebooks.decoded(coded, books).join(table.where("vec_id < 600"), F.col("id") == F.col("vec_id"))
    far = [max(abs(a - b) for a, b in zip(r["approximation"], r["embedding"])) for r in near.collect()]
    assert sum(far) / len(far) < 0.5


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    points = rng.integers(-codebooks.LARGEST, codebooks.LARGEST, (50, 16))
    book = rng.integers(-codebooks.LARGEST, codebooks.LARGEST, (9, 16))
    best, far = codebooks.nearest_entry(points, book)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in book] for p in points]
    assert far.tolist() == [min(w) for w in want] and best.tolist() == [w.index(min(w)) for w in want]


def test_vectors_of_odd_lengths(spark):
    table = spark.createDataFrame([(1, 1, [0.5] * 4), (2, 1, [0.5] * 8)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="one length"):
        codebooks.compressed(table)
    assert codebooks.compressed(table.limit(0))[0].count() == 0
    table = spark.createDataFrame([(1, 1, [1e30] * 4)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="below"):
        codebooks.compressed(table)


# --- conversations -------------------------------------------------------------


def plain_repair(lines):
    """(cost, audit) by trying all edits of each suffix."""

    @lru_cache(None)
    def best(i, state, inserts):
        out = [(0, "")] if i == len(lines) and state in dialogue.ACCEPTING else []
        steps = [("I", 3, i, dialogue.AFTER[dialogue.NEXT[state]], inserts + 1)] if inserts < 4 else []
        if i < len(lines):
            x = lines[i]
            steps.append(("D", 4, i + 1, state, 0))
            if not x.doomed:
                mark = 3 * x.truncated
                steps.append(("R", 3 + mark, i + 1, dialogue.AFTER[dialogue.NEXT[state]], 0))
                if (state, x.initial) in dialogue.KEPT:
                    steps.append(("K", mark, i + 1, dialogue.KEPT[state, x.initial], 0))
        for edit, cost, j, after, used in steps:
            more, audit = best(j, after, used)
            out.append((cost + more, edit + audit))
        return min(out, default=(10**9, ""))

    for i in range(len(lines), -1, -1):  # from the end, so that calls stay shallow
        for state in range(4):
            best(i, state, 0)
    return best(0, dialogue.START, 0)


def test_search_finds_the_least_audit():
    rng = random.Random(3)
    for _ in range(1500):
        roles = ["user", "assistant", "system", "tool", " "][: rng.choice([2, 3, 5])]
        texts = ["a.", "b", "c!", " ", ""][: rng.choice([1, 3, 5])]
        lines = [dialogue.line(rng.choice(roles), rng.choice(texts), rng.random() < 0.15) for _ in range(rng.randint(0, 8))]
        want = plain_repair(tuple(lines))
        assert dialogue.cheapest(lines) == want
        talk, size = dialogue.Conversation(), rng.randint(1, 3)
        for at in range(0, len(lines), size):
            talk.joined(lines[at : at + size], dialogue.paths_between(lines[at : at + size]))
        assert talk.result()[5:7] == want


def plain_conversations(rows):
    """Damaged (conv_id, turn, role, text) rows to results; turns are unique or rows equal."""
    talks = {}
    for conv, turn, role, text in rows:
        held = talks.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        said = [" " if x is None else str(x) for x in (conv, turn)]
        draw = zlib.crc32(":".join(said).encode()) % 20
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(draw, text)
        held += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for conv, held in talks.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, lines = set(), []
        for _, role, text in held:
            lines.append(dialogue.line(role, text, (role, text) in seen))
            seen.add((role, text))
        turns = {t for t, _, _ in held if t is not None}
        cost, audit = plain_repair(tuple(lines))
        left = "\n".join(dialogue.repaired(lines, audit)[0])
        illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        yield (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            sum(x.blank for x in lines), sum(x.repeated and not x.blank for x in lines), sum(x.truncated for x in lines),
            illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest(),
        )


def conversations():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", None, "", "tool"], ["Yes.", "no", "Really?", None, "", " \n\t ", "日本。", "ok!  "]
    rows = []
    for conv in [*range(60), None]:
        turns = rng.sample(range(-3, 40), rng.randint(1, 9))
        rows += [(conv, t, rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts)) for t in turns]
    rows += [(61, None, "user", "Hi.")] + [(62, 1, "user", "Hi.")] * 3
    return rows + [(63, t, rng.choice(roles[:2]), f"Line {t % 50}.") for t in range(400)]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("partitions", [1, 7])
def test_conversations_agree_with_plain_python(spark, tmp_path, partitions):
    rows = conversations()
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in queries.op12_dialogue_repair(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=key) == sorted(plain_conversations(rows), key=key)


def test_long_conversation_in_pieces_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "HELD", 2)
    rows = [(0, 0, "user", "A."), *((1, t, "user" if t % 3 else "assistant", f"Text {t}.") for t in range(300)), (2, 0, "user", "A.")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").coalesce(1)
    got = {r["conv_id"]: r for r in dialogue.repair_conversations(table).collect()}
    lines = [dialogue.line(r, t, False) for c, _, r, t in rows if c == 1]
    whole = dialogue.Conversation()
    whole.whole(lines)
    assert tuple(got[1])[6:] == whole.result()[5:] and len(got[1]["audit"]) >= 300
    assert got[0]["cost"] == 3 and got[0]["audit"] == "KI"


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert dialogue.repair_conversations(none).count() == 0


# --- pages ---------------------------------------------------------------------

PAGE = (
    '<!DOCTYPE html><head><meta charset=x><title>T &amp; U</title><style>p{}</style><body class="has-ads"><header><h1>Site</h1></header>'
    '<div class="top">Hello world</div><main><p>bread</p><article class="post related-open"><header><h1>Head</h1></header>'
    '<p>Real <b>uni</b>que&nbsp;text.<br>More &lt;b&gt; &am<script>if (a<b) "</p>"</script></p><div class="ad-box">Buy</div><p>Last'
    '<section id="comments"><article class="comment"><p>First!</p></article></section><form>q<input></form></article></main>'
    "<aside>Side</aside><ul><li>a<li>b</ul><footer>&copy;"
)


def test_declared_parts():
    page = webpages.read_page(PAGE)
    assert page.settled and webpages.main_text(page, np.zeros(0, np.int64)) == "Head\nReal unique text. More <b> &am\nLast"
    odd = {"": "", "<p>a": "a", "no tags at all": "no tags at all", "<article></article>": "", "<article>x<!-- <p>y": "x", "<nav>m</nav>": ""}
    for source, want in odd.items():
        assert webpages.main_text(webpages.read_page(source), np.zeros(0, np.int64)) == want
    assert webpages.main_text(webpages.read_page("<main>a<div>b</div></main>c"), np.zeros(0, np.int64)) == "a\nb"


def plain_repeats(streams, run=webpages.RUN):
    """Tokens of each stream inside a run that a different stream of the host has too."""
    holders = {}
    for s in streams:
        for i in range(len(s) - run + 1):
            holders.setdefault(tuple(s[i : i + run]), set()).add(tuple(s))
    out = []
    for s in streams:
        covered = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(holders[tuple(s[i : i + run])]) > 1:
                covered[i : i + run] = [True] * run
        out.append(covered)
    return out


def test_host_repeats_are_taken_out_of_open_blocks(spark):
    share = "Share this story with all of your friends on every network you can think of"
    own = ["Apples grow on trees in autumn.", "Boats need water under the keel.", "Cats sleep most of the day."]
    rows = [(i, f"http://h.example/{i}", f"<div>{share}</div><div><p>{t}</p></div><p>{share} Author{i} wrote</p>") for i, t in enumerate(own)]
    rows += [(9, "http://other.example/", f"<div>{share}</div>"), (10, None, f"<div>{share}</div>"), (11, "http://[", None), (None, "http://h.example/x", "")]
    rows += [(20, "http://copies.example/a", "<p>" + own[0] * 9), (21, "http://copies.example/b", "<p>" + own[0] * 9)]
    rows += [(30 + k, f"http://two.example/{k}", f"<article>{share}</article><article>{t}</article>") for k, t in enumerate(own)]
    table = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    found = [sorted(webpages.extract(table, held).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0)) for held in (10**6, 0)]
    assert found[0] == found[1]
    got = {r["page_id"]: r["text"] for r in found[0]}
    assert got[0] == f"{own[0]}\nAuthor0 wrote" and got[2] == f"{own[2]}\nAuthor2 wrote"
    assert got[9] == got[10] == share and got[11] == got[None] == ""
    assert got[20] == got[21] == own[0] * 9 and got[31] == own[1]


def test_menus_inside_the_article_are_taken_out(spark):
    """Links that the host shows around articles are a menu inside one; headings, quoted text and the links of copies stay."""
    tabs = ["News of the day", "Sport and more", "Weather & wind", "Culture in town"]
    menu = "<ul>" + "".join(f"<li><a href=x>{t.replace('&', '&amp;')}</a>" for t in tabs) + "</ul>"
    title = "<h2><a href=y>Eight words of a title that sidebars show as well</a></h2>"
    quoted = "<p>Eight words of a quoted line that pages hold as well"
    sources = "<ul><li><a>First source of eight words or more than these</a><li><a>Second source of eight words or more than these</a></ul>"
    own = ["Apples grow.", "Boats float.", "Cats sleep."]
    around = f"<nav>{menu}{title}{quoted}</nav>"
    page = lambda k: f"<nav>Page{k}</nav>{around}<article>{title}<p>{own[k]}<div>{menu}</div>{quoted}{sources}</article>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(3)]
    rows += [(9, "http://alone.example/", page(0)), (10, None, page(0))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = [{r["page_id"]: r["text"] for r in webpages.extract(table, held).collect()} for held in (10**6, 0)]
    assert found[0] == found[1]
    plain = [quoted[3:], *(x.split("</a>")[0] for x in sources.split("<a>")[1:])]
    for k in range(3):
        assert found[0][k].split("\n") == ["Eight words of a title that sidebars show as well", own[k], *plain]
    alone = ["Eight words of a title that sidebars show as well", own[0], *tabs, *plain]
    assert found[0][9].split("\n") == found[0][10].split("\n") == alone


def test_repeats_agree_with_plain_python(spark):
    rng = random.Random(4)
    bits = [" ".join(rng.choice("abcdefg") for _ in range(12)) for _ in range(6)]
    rows = [(i, "http://h.example/", "<p>".join(rng.choice(bits) for _ in range(4))) for i in range(40)]
    streams = [webpages.read_page(h).stream for _, _, h in rows]
    want = [sum(c) for c in plain_repeats(streams)]
    got = webpages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).orderBy("page_id")
    assert [r["n_repeated"] for r in got.collect()] == want
    assert webpages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", ["op11_codebooks", "op12_dialogue_repair", "op13_main_text"])
def test_whole_tables(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR).collect()
    if name == "op11_codebooks":
        rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
        want, digest = plain_codes(rows)
        assert sorted(tuple(r)[:4] for r in got) == sorted(want) and got[0]["codebooks_sha256"] == digest
    elif name == "op12_dialogue_repair":
        rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert sorted(map(tuple, got)) == sorted(plain_conversations(rows))
    else:
        pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
        assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
        for r in got:
            words = webpages.entities.unescape(webpages.re.sub("<[^>]*>", " ", pages[r["page_id"]].partition("<article>")[2].partition("</article>")[0])).split()
            assert r["text"].split() == words


def test_stages_leave_no_tables_behind(spark, tmp_path):
    """A stage's own tables go when the next one begins, unless its documents are still read from them."""
    import corpus_pipeline
    from mirrorset.llm.staging import new_path, staged

    docs = spark.range(5).withColumn("text", F.lit("x"))
    first = corpus_pipeline.tidied(lambda spark, docs, sf_dir: staged(docs, "inner"))
    last = corpus_pipeline.tidied(lambda spark, docs, sf_dir: docs)
    corpus_pipeline._left.clear()
    lazy = first(spark, docs, "")
    (held,) = corpus_pipeline._left
    assert last(spark, lazy, "").count() == 5 and corpus_pipeline._left == [held]
    written = str(tmp_path / "out")
    lazy.write.parquet(written)
    assert last(spark, spark.read.parquet(written), "").count() == 5 and corpus_pipeline._left == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(held)
    assert new_path(spark, "other") and corpus_pipeline._left == []
