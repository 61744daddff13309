"""The training-data operators against brute force and oracles, and their defined edge cases."""
import base64
import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF_SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from timefuse.llm import bloom_lm, bpe, chat, golay, host_rules, html, queries, shards, simhash, tiling, token_scan, warc
from timefuse.session import scratch_path
from timefuse.tables import load

WORDS = [w + x for w in "alpha beta gamma delta omega sigma kappa lambda".split() for x in ("", "s", "ed")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the operators' result names."""
    long = prose(1, 30_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, prose(2, 80), "b"), (4, prose(2, 80), "b"),
            (5, prose(2, 80), "a"), (6, long, None), (7, long + " more", "a"), (None, prose(3, 30), "b"),
            (8, "Abc def " * 40, "b"), (-9, "x\ny\nx\n\n", "c"), (10, prose(4, 12), "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("kept", "size", "ids", "fp", "score", "n", "n_words", "component")})


@pytest.fixture(scope="module")
def tk():
    with open(queries.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, duck, key):
    df = queries.QUERIES[key](spark, SF_SMALL)
    cur = duck.execute(queries.ORACLE[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


# --- 1: tag paths

def test_main_text_of_generated_pages(spark):
    import re
    from html import unescape
    for page, text in [(r.html, html.main_text(r.html)) for r in load(spark, SF_SMALL, "pages").collect()]:
        inner = re.search("<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert text == "\n".join(p for p in parts if p)


def test_main_text_leaves_out_what_is_around():
    body = "<p>Some <b>long</b> text, with commas, and more of it.<p>Short.<ul><li>one, two<li>three</ul>"
    page = ("<html><body><header>Top</header><div class='side-bar sidebar'>Side</div><form>Field <input></form>"
            f"<div id=content><div class=post><h2>Title</h2>{body}</div></div>"
            "<div class='cookie-notice'>We use cookies, as all do.</div><section id=comments><p>First, a comment.</section>"
            "<script>if (a < b) x('</p>')</script><footer>End</footer>")
    want = "Title\nSome long text, with commas, and more of it.\nShort.\none, two\nthree"
    assert html.main_text(page) == want
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> &nbsp; </p><!-- open") == ""
    assert html.main_text("<p>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.main_text('<a title="a>b">x</a> &lt;b&gt; &eacute;<p>unclosed "<i') .startswith("x <b> é")


@pytest.mark.parametrize("odd", [
    "<svg class='i'/>", "<math />", "<svg><title/><path d='M0'/><g><circle r=1></g>no</svg>", "<svg><a href=x>no</svg>",
    "<object><p>no</p><b>no</object>", "<div><video src=x>no</div>", "<div><select><option>no<option>no</div>",
    "<div><script>no('<p>')</div>", "<div><title>no</div>", "<canvas/>", "<noscript><p>no</noscript>",
    "<template><div>no</div></template>", "<svg>" + "<path d='M0'>" * 3000 + "</svg>"])
def test_embedded_elements_take_nothing_along(odd):
    a, b, c = "First, a paragraph.", "Second, one more.", "Third, the last."
    assert html.main_text(f"<body><article><p>{a}</p>{odd}<p>{b}</p><p>{c}</p></article>") == f"{a}\n{b}\n{c}"
    if "div" not in odd:
        assert html.main_text(f"<body><article><p>{a} {odd} {b}<p>{c}</article>") == f"{a} {b}\n{c}"


@pytest.mark.parametrize("wrap", [
    "<div class='widget Blog' id=Blog1>{}</div>", "<div class='elementor-widget elementor-widget-theme-post-content'>{}</div>",
    "<div class='page right-sidebar'>{}</div>", "<article class=teaser>{}</article>", "<form id=aspnetForm>{}</form>",
    "<div class='page fixed-header'><div class=post-hidden>{}</div></div>"])
def test_names_of_wrappers_take_no_main_text(wrap):
    ps = [f"Paragraph {i}, of the main text, with commas." for i in range(6)]
    inner = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "<div class=share-bar>Tell all, do.</div>"
    page = f"<body><div class=sidebar>Side, by side.</div>{wrap.format(inner)}<div id=comments><p>First, a comment.</div>"
    assert html.main_text(page) == "\n".join(["Title", *ps])


def test_teasers_are_kept_if_nothing_else_is_there():
    page = "<body>" + "".join(f"<div class=c{i}><div class=teaser>Teaser {i}, a text.</div></div>" for i in range(4))
    assert html.main_text(page) == "\n".join(f"Teaser {i}, a text." for i in range(4))
    assert html.main_text("<body><nav>Menu</nav><form><p>Only, a form.</form>") == "Only, a form."


def sentences(n, chars, marks):
    step = chars // marks
    return ["".join("," if i % step == step - 1 else "ab cd ef "[i % 9] for i in range(chars)).strip() + "x" for _ in range(n)]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=post>{}</div>", "{}"])
@pytest.mark.parametrize("n, chars, marks, items, size", [(10, 1500, 25, 40, 25), (1, 20_000, 400, 30, 40), (10, 500, 8, 50, 4)])
def test_short_items_stay_with_long_paragraphs(wrap, n, chars, marks, items, size):
    long, short = sentences(n, chars, marks), [f"{i:02d}" + "y" * (size - 2) for i in range(items)]
    half = n // 2
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in short) + "</ul>"
    table = "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in short[i:i + 5]) + "</tr>" for i in range(0, items, 5)) + "</table>"
    for middle in (listed, table):
        inner = "".join(f"<p>{p}</p>" for p in long[:half]) + middle + "".join(f"<p>{p}</p>" for p in long[half:])
        page = f"<html><body><nav><a href=x>Menu</a></nav>{wrap.format(inner)}<footer>End</footer></body></html>"
        assert html.main_text(page) == "\n".join([*long[:half], *short, *long[half:]])


def test_outside_the_content_the_ratio_decides():
    long = sentences(6, 800, 20)
    page = "<div class=post>" + "".join(f"<p>{p}</p>" for p in long) + "<ul><li>own</ul></div>" \
        + "<div id=bottom>" + "<div>up</div>" * 40 + "</div>"
    assert html.main_text(page) == "\n".join([*long, "own"])


def test_extract_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 7), (1, "u", "<p>a</p>", 7)], "page_id int, url string, html string, text int")
    assert sorted(map(tuple, html.extract(df).collect())) == [(1, "u", ""), (1, "u", "a")]
    assert html.extract(df.limit(0)).count() == 0


# --- 2: SimHash

def test_golay_indices_are_shared_by_neighbours():
    v = np.random.default_rng(1).integers(0, 1 << 23, 300).astype(np.uint32)
    near = golay.near_indices(v, 23)
    for bit in range(23):
        assert (near == golay.index(v ^ np.uint32(1 << bit))[:, None]).any(axis=1).all()


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(find(i), set()).add(f)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("dense", [simhash.DENSE, 2])
def test_links_give_all_components(spark, dense):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:40]:
        g = f
        for _ in range(4):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    comps = {}
    from timefuse.llm.common import connected_components
    for r in connected_components(spark, simhash.links(spark, df, dense)).collect():
        comps.setdefault(r.component, set()).add(r.node & (1 << 64) - 1)
    assert sorted(sorted(g) for g in comps.values()) == brute_components(fps)


def test_keys_are_made_in_tasks_of_bounded_size(spark):
    """A file of few bytes holds fingerprints of very many keys: not one task makes and counts them all."""
    fps = spark.range(0, 45_000, 1, 1).select(F.xxhash64("id").alias("fp"))
    for made in (simhash._keyed(fps), simhash._dealt(fps.limit(1000).coalesce(1), simhash.DENSE)):
        rows = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(rows) >= 4 and max(rows) <= 1.3 * simhash.TASK_KEYS


def test_near_duplicates_of_edge_rows(spark, docs):
    rows = simhash.near_duplicates(spark, docs).collect()
    assert len(rows) == docs.count()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert got[1] == got[2] == got[3] == {("0" * 16, 1)}
    assert got[4] == got[5] and next(iter(got[5]))[1] == 4
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and None in ids and {1, 4, 6} <= set(ids) and not {2, 3, 5} & set(ids)


def test_rows_of_one_id_in_two_components(spark):
    a, b, c = (prose(i, 300) for i in (61, 62, 63))
    # 5 is alone in two components, 7 in one and with 6 in another, 8 twice in one and once in another
    rows = [(5, a, 1), (5, b, 2), (6, c, 3), (7, c, 4), (7, prose(64, 300), 5), (8, prose(65, 300), 6), (8, prose(65, 300), 7),
            (8, prose(66, 300), 8), (9, b, 9), (None, a, 10)]
    df = spark.createDataFrame(rows, "doc_id int, text string, component int")
    kept = simhash.keep_one(spark, df)
    assert kept.columns == df.columns and kept.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    got = sorted(r.component for r in kept.collect())
    assert got in ([1, 2, 3, 5, 6, 8], [1, 2, 3, 5, 7, 8])  # row 10 has no id and the text of row 1


def test_fingerprint_bits():
    from xxhash import xxh64_intdigest
    text = "A b  c\td e b c"
    w = text.lower().split()
    h = [xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(b"One TWO") == xxh64_intdigest("one two", 42)


# --- 3 and 6: tokens

def test_prefix_table_appends_and_edits(tk):
    voc = bpe.encoder(queries.VOCABULARY, public_tokenizers.PATTERN).vocabulary
    rng = random.Random(3)
    data = "".join(rng.choice("abcéthe ") for _ in range(600)).encode()
    table = bpe.PrefixTable(voc, data[:200])
    table.append(data[200:])
    for _ in range(60):
        assert table.ids() == tk._core_bpe.encode_single_piece(data)
        a = rng.randrange(len(data))
        b, new = min(len(data), a + rng.randrange(20)), bytes(rng.choice(b"abc the") for _ in range(rng.randrange(9)))
        table.replace(a, b, new)
        data = data[:a] + new + data[b:]


def test_encoder_agrees_with_the_library(tk):
    enc = bpe.encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = ["".join(chr(c) for c in (32, p, 49, 32, p, p, 10, 32)) for p in [*range(0x3000), *range(0x3000, 0xD800, 97)]]
    texts += ["".join(rng.choice("ab the\n'sé한\x1c\x85 #9") for _ in range(n)) for n in (0, 1, 9, 2000)] + ["a" * 9000]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tk.encode_ordinary(t)


def test_encoder_memory_is_bounded_and_forgets_rightly(tk, monkeypatch):
    """Half a million different pieces cost a worker less than 60 MB beside the vocabulary, and full tables give the same ids."""
    def own():
        return sum(int(x) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon") for x in line.split()[1:2]) >> 10

    rng = random.Random(5)
    enc, held = bpe.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN), own()
    for _ in range(250):
        enc.encode("".join(" " + "".join(rng.choices("abcdefgh", k=7)) for _ in range(1_800)))
    assert own() - held < 60
    for name, value in (("RECENT", 3), ("PIECES", 8), ("PIECE_BYTES", 100), ("PAIRS", 16)):
        monkeypatch.setattr(bpe, name, value)
    for dtype in ("<u4", "<u2"):
        enc = bpe.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN, dtype)
        for n in range(1, 120):
            t = "".join(rng.choice(["the ", " é", "\U0001f600" * 50, "ab" * n, "\n", "9", "한 "]) for _ in range(n))
            assert np.frombuffer(enc.encode(t), dtype).tolist() == tk.encode_ordinary(t)
            assert len(enc) <= 3 and enc.known.n <= 8


def test_many_pieces_are_encoded_together():
    """The tables of many new pieces at once: the ids of each one's own table, in under half of the time."""
    rng = random.Random(7)
    pieces = list({"".join(rng.choices("the and é한ß0", k=rng.randint(1, 14))).encode() for _ in range(12_000)})
    voc = bpe.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN).vocabulary
    own = [bpe.PrefixTable(voc, p).ids() for p in pieces]  # also fills the table of pairs, for both
    began = time.process_time()
    assert [bpe.PrefixTable(voc, p).ids() for p in pieces] == own
    each = time.process_time() - began
    packed = voc.encode(pieces, "<u4")
    assert time.process_time() - began - each < each / 2
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == own


def test_encode_and_decode_rows(spark, docs, tk):
    out = bpe.decode(bpe.encode(docs, queries.VOCABULARY, public_tokenizers.PATTERN), queries.VOCABULARY)
    got = sorted((str(r.doc_id), bytes(r.decoded), np.frombuffer(r.ids, "<u4").tolist()) for r in out.collect())
    want = sorted((str(r.doc_id), (r.text or "").encode(), tk.encode_ordinary(r.text or "")) for r in docs.collect())
    assert got == want
    assert bpe.encode(docs.limit(0), queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_encode_and_decode_in_one_worker_a_task(spark, docs, capsys):
    """The round trip is one Python step of its stage, with the rows of the two operators one after the other."""
    twice = bpe.decode(bpe.encode(docs, queries.VOCABULARY, public_tokenizers.PATTERN), queries.VOCABULARY)
    once = bpe.encode(docs, queries.VOCABULARY, public_tokenizers.PATTERN, decoded="decoded")
    assert once.schema == twice.schema and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    queries.encoded(docs).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


@pytest.mark.parametrize("block", [5, 64, token_scan.BLOCK_TOKENS])
def test_token_scan_across_blocks(spark, docs, tk, block):
    path = scratch_path(spark, "tokens")
    token_scan.write_token_files(docs, path, queries.VOCABULARY, public_tokenizers.PATTERN, queries.SEPARATOR, file_documents=2)
    rows = token_scan.documents(spark, path, queries.SEPARATOR, block).collect()
    want = sorted((str(r.doc_id), len(tk.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    assert all(r.closed for r in rows)


def test_token_scan_of_foreign_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([7, 9, 9, 7, 3], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    rows = token_scan.documents(spark, str(tmp_path), 7, 2, header=0).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_tokens, r.closed) for r in rows] == [(0, 0, 0, True), (1, 1, 2, True), (2, 4, 1, False)]


# --- 4: host rules

def test_host_rules_of_edge_rows(spark, docs):
    rows = host_rules.with_verdicts(spark, docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed
    assert got[8].n_repeat_words == 80 and got[8].base_failed and got[-9].n_dup_lines == 1
    assert got[4].kept and got[6].n_words == 30_000 and got[4]["size"] == "clash"
    assert host_rules.with_verdicts(spark, docs.limit(0)).count() == 0


def test_a_failing_host_loses_all_its_documents(spark):
    rows = [(i, "junk", "bad") for i in range(60)] + [(60, prose(1, 50), "bad")]
    rows += [(100 + i, prose(i, 50), f"good{i % 5}") for i in range(60)]
    out = host_rules.with_verdicts(spark, spark.createDataFrame(rows, "doc_id int, text string, source string"))
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert kept == set(range(100, 160))


# --- 5: language model

def test_filter_levels_probe_all_places_of_a_level_together():
    """The levels of probing place by place, in clearly less time."""
    def one_by_one(f, keys):
        level, live = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        segment = (keys >> np.uint64(64 - f.shift)).astype(np.int64)
        for n in range(1, bloom_lm.MOST_LEVELS + 1):
            place, step = bloom_lm._hashed(keys[live], n)
            start, size = f.start[segment[live]], f.size[segment[live]]
            for _ in range(bloom_lm.HASHES):
                at = start + (place % size).astype(np.int64)
                there = np.flatnonzero(f.data[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                live, start, size, step = live[there], start[there], size[there], step[there]
                place = place[there] + step
            if not len(live):
                break
            level[live] = n
        return level

    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 64, 300_000, dtype=np.uint64))
    counts = rng.geometric(0.6, len(keys))
    segment = (keys >> np.uint64(62)).astype(int)
    sizes = [(s, 10 * int(bloom_lm.levels(counts[segment == s]).sum())) for s in range(3)]  # none for the last
    f = bloom_lm.Filter(sizes, 2)
    for s, bits in sizes:
        f.put(s, bloom_lm.fill(keys[segment == s], counts[segment == s], bits))
    asked = np.concatenate([keys, rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)])
    took = {}
    for run in (bloom_lm.Filter.levels, one_by_one) * 3:
        began = time.process_time()
        got = run(f, asked)
        took[run] = min(took.get(run, 1e9), time.process_time() - began)
        assert got.tolist() == took.setdefault("levels", got.tolist())
    assert (got[: len(keys)][segment < 3] >= bloom_lm.levels(counts)[segment < 3]).all() and not got[: len(keys)][segment == 3].any()
    assert took[bloom_lm.Filter.levels] < 0.85 * took[one_by_one]


def test_scores_of_edge_rows(spark, docs):
    out = bloom_lm.score(spark, docs.filter("doc_id <> 10"), docs, segment_chars=4096).collect()
    tokens = [(r.doc_id, (r.text or "").encode().translate(bloom_lm.LOWER_BYTES).split() + [None]) for r in docs.collect()]
    counts = {}
    for d, t in tokens:
        for w in t if d is not None and d != 10 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(t), sum(w in counts for w in t), n,
                   round(sum(np.log10((counts.get(w, 0) + .1) / (n + .1 * (v + 1))) for w in t), 4)) for d, t in tokens)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out)
    assert got == want and all(r.score < 0 for r in out)
    empty = bloom_lm.score(spark, docs.limit(0), docs).collect()
    assert len(empty) == docs.count() and {r.train_tokens for r in empty} == {0}


def test_blocks_of_the_filter_change_no_score(spark, docs):
    model, bits = bloom_lm.count_grams(spark, docs)
    part = sum(r.pair_bits for r in model.select("pair_bits").collect()) // 24
    assert len(list(bloom_lm._blocks(model, "pair", bits, part))) > 2
    one, many = ({r.doc_id: r.score for r in bloom_lm.score(spark, docs, docs, filter_bytes=size).collect()}
                 for size in (1 << 26, part))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64)), rng.integers(1, 5000, 5000)
    part = bloom_lm.fill(keys, counts, 10 * int(bloom_lm.levels(counts).sum()))
    f = bloom_lm.Filter([(0, 10 * int(bloom_lm.levels(counts).sum()))], 0)
    f.put(0, part)
    assert (f.counts(keys) >= bloom_lm.LEVEL_COUNT[bloom_lm.levels(counts)]).all()
    strange = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert (f.counts(strange) > 0).mean() < 0.05


def test_model_beats_unigrams_on_held_out_documents(spark):
    rows = [r for r in queries.QUERIES["op5_bloom_lm"](spark, SF_SMALL).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# --- 7: archives

def test_archives_of_edge_rows(spark):
    rows = [(1, None, None), (2, "http://a b", ""), (3, "http://x/é", "<p>same\r\n\r\n</p>"), (4, "u", "<p>same\r\n\r\n</p>"),
            (4, "u", "<p>same\r\n\r\n</p>"), (None, "v", "own"), (6, "w", "é" * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for version in (1, 2):
        arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
        warc.write_arc(df, arc, version)
        records = warc.read_arc(spark, arc)
        assert {r.version for r in records.select("version").collect()} == {version}
        warc.write_warc(warc.convert(spark, records), out)
        got = warc.read_warc(spark, out).filter("type <> 'warcinfo'").withColumn(
            "id", warc.header_value(F.col("head"), "X-Page-Id")).collect()
        assert all(r.complete for r in got)
        assert sorted((str(r.id), r.type) for r in got) == [
            ("1", "revisit"), ("2", "response"), ("3", "revisit"), ("4", "response"), ("4", "revisit"),
            ("6", "response"), ("None", "response")]
        for r in got:
            text = {str(a): c or "" for a, _, c in rows}[str(r.id)].encode()
            assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(text).digest()).decode()
            assert r.payload_length == len(text) and (r.type == "revisit" or bytes(r.payload) == text)
    arc = scratch_path(spark, "arc")
    warc.write_arc(df.limit(0), arc)
    assert warc.read_arc(spark, arc).filter("not startswith(url, 'filedesc')").count() == 0


def test_pages_with_the_url_of_a_version_block(spark):
    rows = [(i, f"filedesc://page {i}", f"<p>{i}</p>") for i in range(4)] + [(4, "filedesc://", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for version in (1, 2):
        arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
        warc.write_arc(df.coalesce(1), arc, version)
        warc.write_warc(warc.convert(spark, warc.read_arc(spark, arc)), out)
        got = warc.read_warc(spark, out).withColumn("id", warc.header_value(F.col("head"), "X-Page-Id")).collect()
        assert sorted(r.id for r in got if r.type == "response") == list("01234")
        assert [r.type for r in got if r.type != "response"] == ["warcinfo"]
    one = b"filedesc://a 0.0.0.0 2001 text/plain 64\n1 0 x\n" + warc.ARC_FIELDS[1].encode() + b"\nab\n"
    two = b"\nfiledesc://b 0.0.0.0 2001 text/plain 200 - - 0 - 120\n2 0 x\n" + warc.ARC_FIELDS[2].encode()
    block = len(two.split(b"\n", 2)[2])
    two = two.replace(b" 120\n", b" %d\n" % block)
    one = one.replace(b" 64\n", b" %d\n" % (len(one.split(b"\n", 1)[1])))
    page = b"\nhttp://c 0.0.0.0 2001 text/html 200 - - 0 - 2\nhi"
    found = [(v, f["URL"], warc.VERSION_BLOCK in f, done) for _, v, f, _, done in warc.arc_records(one + two + page, False)]
    assert found == [(1, "filedesc://a", True, True), (2, "filedesc://b", True, True), (2, "http://c", False, True)]


def test_cut_off_and_foreign_lines():
    data = b"noise\nhttp://a 0.0.0.0 20010101000000 text/html 5\nhello\nhttp://b 0.0.0.0 2001 text/html 9\ncut"
    got = [(f["URL"], block, complete) for _, _, f, block, complete in warc.arc_records(data, False)]
    assert got == [("http://a", b"hello", True), ("http://b", b"cut", False)]


# --- 8: shards

@pytest.mark.parametrize("range_bytes", [shards.RANGE_BYTES, 4000])
def test_shards_of_hot_keys(spark, range_bytes):
    df = spark.range(2000).selectExpr("if(id < 1900, 7, id) doc_id", "repeat('x', cast(id % 30 as int)) text", "id slot")
    rows = shards.shard_by_bytes(spark, df, shards.document_size(), 5, range_bytes=range_bytes).collect()
    assert len(rows) == 2000
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in sorted(by)]
    assert sorted(by) == list(range(5)) and max(sizes) - min(sizes) < 300
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    keys = [(r.shard, r.slot, r.doc_id) for r in rows]
    assert [k[2] for k in sorted(keys)] == sorted(k[2] for k in keys)


def test_shards_of_edge_rows(spark, docs):
    rows = shards.shard_by_bytes(spark, docs, shards.document_size(), 3).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert {r["size"] for r in rows if r.doc_id == 1} == {16}
    assert shards.shard_by_bytes(spark, docs.limit(0), shards.document_size()).count() == 0


# --- 9: tiling

def test_reordered_passages_are_found(spark, docs):
    item = prose(50, 40)
    w = item.split()
    moved = " ".join([prose(51, 30), *w[25:], "between", *w[10:25], *w[:10], prose(52, 20)])
    rows = [(1, moved), (2, " ".join(w[:8]) + " " + prose(53, 60)), (3, None), (None, item.upper()), (4, prose(54, 5000) + " " + item)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "a b c")], "item_id int, text string")
    got = tiling.matches(spark, df, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.covered) for r in got) == [(d, 1, 40) for d in ("1", "1", "4", "4", "None", "None")]
    for r in got:
        if r.doc_id == 1:
            assert [(t.item_at, t.n) for t in r.tiles] == [(25, 15), (10, 15), (0, 10)]
    small = tiling.matches(spark, df, items, block_words=10).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    assert [r.doc_id for r in tiling.clean(spark, df, items).orderBy("doc_id").collect()] == [2, 3]
    assert tiling.clean(spark, docs, items.limit(0)).count() == docs.count()
    assert tiling.matches(spark, df.limit(0), items).count() == 0


def test_tiles_against_plain_greedy_tiling():
    rng = random.Random(4)
    for _ in range(200):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(60))], dtype=np.int64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(40))], dtype=np.int64)
        found = tiling.tiles(a, b, 3)
        used = [set(), set()]
        for d, p, n in found:
            assert n >= 3 and (a[d:d + n] == b[p:p + n]).all()
            for side, at in ((0, d), (1, p)):
                places = set(range(at, at + n))
                assert not places & used[side]
                used[side] |= places
        left = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if (a[i:i + 3] == b[j:j + 3]).all()
                and not {i, i + 1, i + 2} & used[0] and not {j, j + 1, j + 2} & used[1]]
        assert not left


# --- 10: chat

def test_chat_round_trip(spark):
    bad = ["<|im_end|>", "<\\|x|>", "a<", "<<|im_start|>user\n", None, "", "\\", "<|", "é\n<|im_end|>\n"]
    rows = [(i, t, r, x) for i, x in enumerate(bad) for t, r in ((0, "user"), (1, "assistant"))]
    rows += [(50, 1, "gpt", "q"), (50, 1, "gpt", "q"), (50, 0, None, "z"), (51, 0, "odd role\n|", "y"), (51, 1, "human", "h"),
             (None, 0, "assistant", "n"), (52, 0, "system", "s"), (52, 1, "user", "u"), (52, 2, "assistant", "a"),
             (53, 0, "user", "u"), (53, 1, "assistant", "a<|im_end|>"), (53, 2, "user", "v")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("mask", F.lit(1))
    out = chat.read_back(chat.formatted(chat.canonical(chat.as_records(chat.gathered(df))))).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert len(out) == len(want) and {o.layout for o in out} == {"messages", "conversations", "prompt", "instruction"}
    for o in out:
        assert [(t.role, t.text) for t in o.read] == [(r, x) for _, r, x in sorted(want[o.conv_id])]
        assert [t.loss for t in o.read] == [x if r == "assistant" else "" for _, r, x in sorted(want[o.conv_id])]
        assert sum(m.before + m.text + m.after for m in o["mask"]) == len(o.formatted)
    assert chat.as_records(chat.gathered(df.limit(0))).count() == 0


def chat_round(df, **sizes):
    return chat.read_back(chat.formatted(chat.canonical(chat.as_records(chat.gathered(df), **sizes))))


@pytest.mark.parametrize("piece, run", [(3, 70), (4, 400), (1, 1)])
def test_conversations_in_several_records(spark, piece, run):
    texts = ["<|im_end|>" * 3, "", "é<|" * 9, "a\n\"\\", "😀" * 7, None]
    rows = [(c, t, r, x) for c in (1, 2) for t, x in enumerate(texts * 2) for r in ("user", "assistant", "xxxhuman")]
    rows += [(3, 0, "human", "h" * 500), (4, 0, "user", "<" * 500), (4, 1, "assistant", "|" * 500), (None, 0, "gpt", "n" * 500)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert chat.as_records(chat.gathered(df), piece=piece, run=run).filter("record is null and size(parts) > 1").count() > 2

    def seen(out):
        return {r.conv_id: (r.read, r.formatted, r["mask"]) for r in out.collect()}

    assert seen(chat_round(df, piece=piece, run=run)) == seen(chat_round(df))


def test_texts_too_long_for_the_json_readers(spark):
    n = 21_000_000
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"),
                               F.expr(f"repeat('x', {n})").alias("text"))
    r = chat_round(df).select(F.size("read"), F.expr("length(read[0].text)"), F.expr("length(read[0].loss)"),
                              F.length("formatted"), "layout").first()
    assert tuple(r) == (1, n, n, n + 9 + 24, "conversations")
    foreign = df.select(F.to_json(F.struct(F.col("text").alias("prompt"), F.lit("a").alias("completion"))).alias("record"))
    with pytest.raises(Exception, match="cannot parse a record of 21000"):
        chat.formatted(chat.canonical(foreign)).select(F.length("formatted")).collect()


def test_unknown_layouts_are_reported(spark):
    df = spark.createDataFrame([('{"prompt":"p","completion":null}',), ('{"question":"p"}',), ("no json",), (None,)], "record string")
    out = chat.formatted(chat.canonical(df)).collect()
    assert [r.layout for r in out] == ["prompt", None, None, None]
    assert out[0].formatted == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and out[1].formatted is None


# --- the pipeline

def test_pipeline_against_brute_force(spark, duck, tk):
    kept = dict(duck.execute(f"SELECT doc_id, text FROM documents JOIN ({queries.ORACLE['op4_host_rules']}) USING (doc_id) "
                             "WHERE kept").fetchall())
    ids = sorted(kept)
    fps = np.array([simhash.fingerprint(kept[i].encode()) for i in ids], dtype=np.uint64)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            near = [ids[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3)]
            least = min(label[j] for j in near)
            if least < label[i]:
                label[i], changed = least, True
    items = [r.text for r in load(spark, SF_SMALL, "benchmark").collect()]
    grams = [[" ".join(w[i:i + 5]) for i in range(len(w) - 4)] for w in map(tiling.words, items)]
    want = []
    for i in ids:
        text = " ".join(tiling.words(kept[i]))
        if label[i] == i and not any(sum(g in text for g in gs) >= 0.5 * len(gs) for gs in grams if gs):
            data = np.array(tk.encode_ordinary(kept[i]), "<u4").tobytes()
            want.append((i, len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(kept[i].encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == want


def test_stages_take_edge_rows(spark, docs):
    base = docs.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("bigint")})
    for df in (base, base.limit(0)):
        out = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF_SMALL)
            assert out.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF_SMALL).columns[0] == "doc_id"


def test_quality_hands_own_columns_on(spark):
    rows = [(i, prose(i, 50), "a") for i in range(3)] + [(3, "junk", "a")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumns(
        {c: F.concat(F.lit(c), F.col("doc_id")) for c in ["N_Words", *host_rules.ADDED[1:]]})
    out = corpus_pipeline.quality(spark, df, SF_SMALL)
    assert out.schema == df.schema and sorted(out.collect()) == sorted(df.filter("doc_id < 3").collect())


def test_held_out_rule(spark):
    for r in queries.QUERIES["op5_bloom_lm"](spark, SF_SMALL).limit(20).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
