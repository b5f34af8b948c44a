"""The text operators against brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import MIDDLE, SMALL
from wayfare.llm import chat, components, decontaminate, divergence, langid, minhash, packing, passages, repeats, sharding, site_quality
from wayfare.llm import queries as registered

from .conftest import ODD

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def removed(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(x[i : i + length]) for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        change = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if seen[hash(x[i : i + length])] > 1:
                change[i] += 1
                change[i + length] -= 1
        gone = np.cumsum(change)[:-1] > 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes() if x else b""
        out.append((len(x), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


PERIODIC = "ab" * 700
HARD = [*ODD, (11, PERIODIC + "q" * 399 + PERIODIC), (12, "héé" * 300 + "z" + "héé" * 300), (13, "".join(map(str, range(400)))), (14, "p" * 200 + "".join(map(str, range(400))) + "p" * 500)]


@pytest.mark.parametrize("most", [2000, 3, 1])
def test_repeats_match_brute_force(docs_of, most):
    got = repeats.remove_repeats(docs_of(HARD), most=most).collect()
    want = [(i, *r) for (i, _), r in zip(HARD, removed([t for _, t in HARD]), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_repeats_of_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, removed([r.text for r in rows]), strict=True)}
    got = registered.op1_repeated_bytes(spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_matching_statistics_of_an_index():
    texts = [b"banana", b"bandana", b"an"]
    index = repeats.RunIndex(texts)
    got = index.matching_statistics()
    joined = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
    prefix = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for k, i in joined:
        assert got[index.begin[k] + i] == max(prefix(texts[k][i:], texts[m][j:]) for m, j in joined if (m, j) != (k, i))


def near_groups(rows):
    sets, links = {}, Counter()
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    for own in by.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                links[own[a], own[b]] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in links.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = registered.op4_minhash_near_duplicates(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_chain(spark, docs_of):
    """Neighbours of a chain are linked, its ends are not; one component all the same."""
    words = [f"w{k}" for k in range(400)]
    chain = [(100 + k, " ".join(words[k * 8 : k * 8 + 200])) for k in range(8)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(chain)).collect()}
    assert got == {i: g for i, (_, g) in near_groups(chain).items()} and set(got.values()) == {100}


def test_near_duplicates_of_odd_rows(docs_of):
    got = minhash.near_duplicates(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[8].component_id == 7 and not by[8].kept and by[7].kept
    assert by[None].component_id is None and by[None].kept and by[2].n_shingles == 0 and by[4].n_shingles == by[5].n_shingles == 1


def test_signature_estimates_similarity(spark):
    import pyarrow as pa

    a = [f"x{k}" for k in range(1000)]
    values, at = minhash.shingles(pa.array([" ".join(a), " ".join(a[:900] + ["y"] * 100)]))
    planes = minhash.bit_planes(minhash.minima(values, at, minhash._MULTIPLIERS[: minhash.HASHES])).view(np.int64).tolist()
    row = spark.createDataFrame([tuple(planes)], "x array<long>, y array<long>")
    estimate = row.select(minhash.similarity(minhash.equal_places(F.col("x"), F.col("y")))).first()[0]
    first, second = set(values[at[0] : at[1]].tolist()), set(values[at[1] : at[2]].tolist())
    assert abs(estimate - len(first & second) / len(first | second)) < 0.12


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (2, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, **{k: 100 for k in range(101, 130)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PASSAGE = " ".join(f"passage{k}" for k in range(70))


def filler(seed, n=60):
    return " ".join(f"f{seed}x{k}" for k in range(n))


def test_passages_inside_other_text_are_removed(docs_of):
    rows = [(200 + k, f"{filler(k)} {PASSAGE} {filler(-k - 1)}") for k in range(6)] + [(300, filler(50, 200)), *ODD]
    got = {r.doc_id: r for r in passages.remove_passages(docs_of(rows)).collect()}
    assert len(got) == 7 + len({i for i, _ in ODD}) and got[200].n_removed == 0 and got[300].n_removed == 0
    assert got[300].kept_sha256 == hashlib.sha256(filler(50, 200).encode()).hexdigest()
    for k in range(1, 6):
        one = got[200 + k]
        assert one.n_words_removed >= 40 and "passage35" not in one.kept_text and f"f{k}x3" in one.kept_text


def test_paragraphs_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = [f"{filler(k, 30 + k)}\n{PASSAGE}" for k in range(5)]
    together = passages.lines_and_pieces(pa.array(texts))
    for k, t in enumerate(texts):
        for all_, alone in zip(together, passages.lines_and_pieces(pa.array([t])), strict=True):
            own = all_.text == k
            assert all((getattr(all_, c)[own] == getattr(alone, c)).all() for c in ("ordinal", "start", "end", "count"))


def test_edited_lines_are_removed_and_unlike_ones_stay(docs_of):
    """Lines of 60 words with one word changed are near copies, with a quarter changed they aren't."""
    rng = np.random.RandomState(2)
    base = [[f"b{k}w{j}" for j in range(60)] for k in range(30)]
    rows = []
    for k, line in enumerate(base):
        one, many = list(line), list(line)
        one[int(rng.randint(60))] = f"new{k}"
        for j in range(0, 60, 4):
            many[j] = f"other{k}x{j}"
        rows += [(1000 + k, f"{filler(5000 + k)}\n" + " ".join(line)), (2000 + k, " ".join(one) + f"\n{filler(6000 + k)}"), (3000 + k, " ".join(many) + f"\n{filler(7000 + k)}")]
    got = {r.doc_id: r.n_words_removed for r in passages.remove_passages(docs_of(rows)).collect()}
    assert all(got[1000 + k] == 0 and got[3000 + k] == 0 for k in range(30))
    assert sum(got[2000 + k] == 60 for k in range(30)) >= 27


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|end|>\n\\ b"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, "user", "hi"), (4, 0, None, None), (5, 1, "assistant", "é"), (5, 0, "we|>ird", "<|user|>"), (6, 0, "user", "hi"), (6, 1, "assistant", "other"), (None, 0, "user", "x")]
    packs = chat.format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, path string"))
    got = {r.conv_id: r for r in chat.read_back(packs).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(role or "", text or "") for c, _, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.format_turn(*t)) for t in turns)


def test_chat_writes_shared_turns_once(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "shared opening" if t == 0 else f"{c}/{t}") for c in range(50) for t in range(4)]
    packs = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert sum(p.text.count("shared opening") for p in packs) <= len(packs)
    node = next(n for p in packs for n in p.nodes if n.parent >= 0 and n.attend)
    assert node.position == sum(a.end - a.start for a in node.attend)


def test_leaks_match_brute_force(spark, docs_of):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "two three"), (3, ""), (4, None), (5, "É"), (10, "b C"), (None, "a")]
    docs = [(1, "a b c"), (2, None), (3, ""), (4, "One two three four five six seven eight nine ten eleven x one two three y É ß"), (5, "x two three"), (6, "É ß"), *((k + 10, t) for k, (_, t) in enumerate(ODD))]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    got = {r.doc_id: r for r in decontaminate.leak_report(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for key, of in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    own |= of
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(own), digest, bool(hit))
    clean = {r.doc_id: r.text for r in decontaminate.without_leaks(docs_of(docs[:6]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean[1] == "a " and clean[5] == "x " and clean[4] == "x one y ß" and clean[6] == "ß" and clean[2] is None


def test_leaks_without_a_benchmark(spark, docs_of):
    got = decontaminate.leak_report(docs_of(ODD), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)


def test_shards_are_even_and_mixed(spark, docs_of):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"))
    got = sharding.stratified_shards(rows, bucket_rows=300).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    mixture = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mixture.max(axis=1) - mixture.min(axis=1) <= 2 + 0.05 * mixture.max(axis=1)).all()
    odd = sharding.stratified_shards(docs_of(ODD)).collect()
    assert len(odd) == len(ODD) and {r.doc_id: (r.size, r.text_crc32) for r in odd}[1] == (1, 0)
    assert {r.doc_id: r.text_crc32 for r in odd}[9] == zlib.crc32(("é ü ñ " * 50).encode())


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {j for k in range(len(words) - 4) if count[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(words) < 10 or 100 * len(again) > 20 * len(words)


def test_rules_match_brute_force(docs_of):
    rows = [*ODD, (20, "a b c d e a b c d e a"), (21, "x" * 50 + "\n \nq q\nq q"), (22, "# $ é"), (23, "q " * 5), (24, "w x y z v w x y z v"), (25, filler(3, 100) + "\n" + filler(4, 100))]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in divergence.divergence_rules(docs_of(rows)).collect()}
    assert got == {(i, *base_rules(t)) for i, t in rows}


def test_rules_keep_good_documents(spark):
    verdict = registered.op7_divergence_rules(spark, MIDDLE).toPandas().merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    good = verdict[(verdict.quality == 1) & ~verdict.base_failed]
    assert good.kept.mean() > 0.99 and verdict[verdict.quality == 0].kept.mean() < 0.05


def test_languages_of_held_out_documents(spark):
    got = registered.op8_language_network(spark, MIDDLE).toPandas().merge(spark.read.parquet(f"{MIDDLE}/documents.parquet").toPandas(), on="doc_id")
    out = got[got.held_out & got.lang.notna()]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True)) and got.score.between(0, 1).all()


def test_language_of_odd_rows(docs_of):
    got = {r.doc_id: r for r in langid.identify_languages(docs_of([*ODD, (30, "12 34 !?")])).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 30)] == ["und"] * 4 and got[9].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify_languages(docs_of(ODD, lang=None)).collect()} == {"und"}


def test_site_quality_rejects_what_is_labelled(spark):
    got = registered.op9_site_quality(spark, MIDDLE).toPandas().merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.05 and got[got.toxic == 1].kept.mean() < 0.35


def test_site_quality_of_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(7, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert site_quality.judge(docs_of(ODD, source=None), labels).count() >= len(ODD)
    none = site_quality.judge(docs_of(ODD), labels.limit(0)).collect()
    assert all(r.kept for r in none)


def posteriors(rows):
    """Plain version of the two levels: rows (host, path, p) to each row's host and path means, itself left out."""
    def spread(groups, above, within):
        n, nn = sum(map(len, groups)), 0.0
        between = sum(len(g) * (np.mean(g) - np.mean(a)) ** 2 for g, a in zip(groups, above, strict=True))
        nn = sum(len(g) ** 2 / len(a) for g, a in zip(groups, above, strict=True))
        tau = (between - (len(groups) - len({id(a) for a in above})) * within) / max(n - nn, 1e-9)
        return min(max(within / tau, 0.01), 1e9) if tau > 0 else 1e9

    every = [p for _, _, p in rows]
    hosts, paths = {}, {}
    for h, x, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, x), []).append(p)
    within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in paths.values()) / (len(rows) - len(paths))
    host_worth, path_worth = spread(list(hosts.values()), [every] * len(hosts), within), spread(list(paths.values()), [hosts[h] for h, _ in paths], within)
    out = []
    for h, x, p in rows:
        host = (sum(hosts[h]) - p + host_worth * np.mean(every)) / (len(hosts[h]) - 1 + host_worth)
        path = (sum(paths[h, x]) - p + path_worth * host) / (len(paths[h, x]) - 1 + path_worth)
        out.append((host, path if sum(k[0] == h for k in paths) > 1 else host))
    return out


def test_posteriors_of_two_levels_match_a_plain_version(spark):
    rng = np.random.RandomState(3)
    rows = []
    for h in range(12):
        for x in range(1 + h % 4):
            rows += [(f"h{h}", f"h{h}/{x}", float(1 / (1 + np.exp(-rng.normal(rng.normal(h - 6, 0.01) / 3 + x, 1.5))))) for _ in range(1 + (h * 7 + x * 5) % 23)]
    want = posteriors(rows)
    scored = spark.createDataFrame([(k, h, x, float(np.log(p / (1 - p))), 0.0) for k, (h, x, p) in enumerate(rows)], "k int, host string, path string, low_odds double, toxic_odds double")
    got = {r.k: (r.host_low, r.path_low) for r in site_quality.with_posteriors(scored).collect()}
    assert all(got[k] == pytest.approx(w, rel=1e-6) for k, w in enumerate(want)) and len(got) == len(rows)


def test_sparse_sites_shrink_toward_the_levels_above(spark):
    rows = [("big", "big", 3.0)] * 400 + [("big", "big/one", -3.0)] * 2 + [("small", "small", 3.0)] * 2 + [("rest", "rest", -3.0)] * 400
    rows = [(h, p, x + 0.5 * (-1) ** k) for k, (h, p, x) in enumerate(rows)]
    scored = spark.createDataFrame([(h, p, x, -3.0) for h, p, x in rows], "host string, path string, low_odds double, toxic_odds double")
    got = {r.path: r for r in site_quality.with_posteriors(scored).collect()}
    assert got["big"].path_low > 0.85 and got["rest"].path_low < 0.15 and got["small"].path_low > 0.5
    assert got["big"].path_toxic == pytest.approx(got["big"].all_toxic, abs=1e-6)  # sites that don't differ don't count


def test_site_weight_is_fitted():
    rng = np.random.RandomState(0)
    shift, odds = rng.normal(0, 2, 4000), rng.normal(0, 1, 4000)
    draw = lambda x: (rng.uniform(size=4000) < 1 / (1 + np.exp(-x))).astype(int)
    assert site_quality.fit_weight(odds, shift, draw(odds)) < 0.15 and site_quality.fit_weight(odds, shift, draw(odds + shift)) > 0.85


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in ODD if i is not None] + [(40, "It's <|endoftext|> DON'T, é Ⅷ日本語  x!!a.b"), (41, "Word," * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, TOKENS).toPandas()
    tokenizer, want = Tokenizer.from_file(TOKENS), []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096


def test_open_bins_close_the_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert bins.add(6, "a") is None and bins.add(5, "b") is None
    assert bins.add(4, "c") == [("a", 0), ("c", 6)]  # the best fit, now full
    assert bins.add(7, "d") is None
    assert bins.add(8, "e") == [("d", 0)]  # no place: the fullest closes
    assert [b for b, in bins.rest()] == [("e", 0), ("b", 0)]


@pytest.mark.parametrize("run", [repeats.remove_repeats, minhash.near_duplicates, passages.remove_passages, divergence.divergence_rules, langid.identify_languages, sharding.stratified_shards, lambda d: packing.pack_documents(d, TOKENS)])
def test_empty_tables_give_no_rows(docs_of, run):
    assert run(docs_of([])).count() == 0
