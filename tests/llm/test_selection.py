"""URL filters, importance resampling and conversation repair, against brute force and SQL."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import conversation_repair as repair
from tidemark.llm import importance, url_rules


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def same(df, sql, **tables):
    names, rows = duck(sql, **tables)
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.select(*names).collect()) == collections.Counter(rows)


URLS = [
    None, "", "no scheme example.com/en/x", "http://example.com/en/1", "https://EXAMPLE.com/en/", "http://www.example.com/en/a?b#c", "http://a.www.example.com/en/a", "http://example.com/EN/1",
    "http://com", "http://com/", "http://x.com", "http://notcom/", "http://a.net/es/", "http://a.net/es", "ftp://b.c.net/fr/x?y", "http://net/fr/#z", "://net/es/q", "http://telecom/x", "http://a.net:80/es/",
    "http://cheap-pills.example.org/x", "http://www.Cheap-Pills.org/x", "http://xcheap-pills.org/", "http://s.org/?u=http://cheap-pills.com", "http://spam-farm.com/", "http://casino-a.b.win/", "http://casino-a.b.win", "http://casino.windy/",
    "http://a.org/ads/x", "http://a.org/Ads/x", "http://a.org/legal/ads/x", "http://a.org/banner1/x.gif?y", "http://a.org/banner.gifs", "http://a.org/x.exe", "http://a.org/x.exe?y", "http://a.org/?sessionid=4", "http://a.org/cart", "http://a.org/carts", "http://a.org/cart%20",
    "http://a\nb.com/\n/ads/", "http://é.net/fr/ü", "http://a.org/" + "x/" * 40_000 + "ads/", "x" * 200_000,
]


def host_path(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def pattern_fits(rule, url):
    """The rule read letter by letter, without regular expressions."""
    low = "".join(c.lower() if c.isascii() else c for c in url)
    fixed, ended = rule.startswith("|"), rule.endswith("|") and len(rule) > 2
    starts = range(len(low) + 1)
    if rule.startswith("||"):
        scheme, mark, _ = low.partition("://")
        if not mark or not re.fullmatch("[a-z][a-z0-9+.-]*", scheme):
            return False
        first, host = len(scheme) + 3, host_path(low)[0]
        starts = [first] + [first + k + 1 for k, c in enumerate(host) if c == "."]
    elif fixed:
        starts = [0]
    body = rule.strip("|")

    def fits(k, at):
        for k in range(k, len(body)):  # noqa: B020
            if body[k] == "*":
                return any(fits(k + 1, j) for j in range(at, len(low) + 1))
            if body[k] == "^":
                if at == len(low):
                    return k == len(body) - 1
                if low[at] in "abcdefghijklmnopqrstuvwxyz0123456789_.%-":
                    return False
            elif at >= len(low) or low[at] != body[k]:
                return False
            at += 1
        return not ended or at == len(low)

    return any(fits(0, at) for at in starts)


def judged(url, rules):
    host, path = host_path(url)
    best = {}
    for action, rule, kind in rules:
        if kind == "host":
            h, slash, p = rule.partition("/")
            fits = (host == h or host.endswith("." + h)) and path.startswith(slash + p) and "://" in (url or "")
        else:
            fits = url is not None and pattern_fits(rule, url)
        if fits:
            best[kind] = min(best.get(kind, (1, "", "")), (-len(rule), action, rule))
    won = best.get("host") or best.get("pattern")
    return host, path, best.get("host", (0, 0, None))[2], best.get("pattern", (0, 0, None))[2], won[1] if won else "allow"


def test_urls_equal_brute_force_and_sql(spark):
    pages = spark.createDataFrame([(k, u, "x", "y", "z") for k, u in enumerate(URLS)] + [(3, URLS[3], "x", "y", "z"), (None, URLS[27], "x", "y", "z")], "page_id bigint, url string, host string, rule string, token string").repartition(3)
    got = url_rules.judge(pages, url_rules.default_rules(spark))
    rules = [(a, r, "host") for a, r in url_rules.HOST_RULES] + [(a, r, "pattern") for a, r in url_rules.PATTERN_RULES]
    rows = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(URLS) + 2
    for k, u in enumerate(URLS):
        r = rows[k]
        assert (r["host"], r["path"], r["rule"], r["pattern"], r["verdict"]) == judged(u, rules), u and u[:80]
    assert rows[None]["verdict"] == "block"
    same(got.drop("tried"), url_rules.ORACLE, pages=pages)


def test_many_rules_try_few(spark):
    """Thousands of rules, also without tokens and shuffled: the same verdicts, and each URL tries few."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 3)))
    urls = [f"http://{'.'.join(word() for _ in range(r.randint(1, 3)))}/{'/'.join(word() for _ in range(r.randint(0, 4)))}{r.choice(['', '/', '?q=' + word()])}" for _ in range(150)]
    rules = {(r.choice(["allow", "block"]), f"{word()}.{word()}/{r.choice(['', word() + '/', word()])}", "host") for _ in range(300)}
    rules |= {(r.choice(["allow", "block"]), r.choice(["", "|", "||", "/"]) + word() + r.choice(["*", "^", "/", ".", ""]) + word() + r.choice(["", "|", "^", "/"]), "pattern") for _ in range(300)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame(sorted(rules), url_rules.RULE_SCHEMA)
    got = {x["page_id"]: x for x in url_rules.judge(pages, table).collect()}
    for k, u in enumerate(urls):
        x = got[k]
        assert (x["host"], x["path"], x["rule"], x["pattern"], x["verdict"]) == judged(u, rules), u
    whole = {x for x in rules if x[2] == "host"}
    tried = [x["tried"] for x in url_rules.judge(pages, spark.createDataFrame(sorted(whole), url_rules.RULE_SCHEMA)).collect()]
    assert max(tried) < len(whole) / 4
    index = url_rules.token_index(pages.select("url").distinct(), table).collect()
    assert len(index) == len(rules) and {x["token"] for x in index} >= {""}


def test_empty_selection_tables(spark, no_docs):
    assert url_rules.judge(spark.createDataFrame([], "page_id bigint, url string"), url_rules.default_rules(spark)).count() == 0
    assert repair.summaries(repair.repair(repair.damaged(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")))).count() == 0
    assert importance.resample(no_docs, no_docs).count() == 0


# importance resampling


def features(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def resampled(rows, target, percent):
    source, aim = collections.Counter(), collections.Counter()
    for _, t in rows:
        source.update(features(t)[1])
    for t in target:
        aim.update(features(t)[1])
    n, m = source.total(), aim.total()
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (n + 10_000) / ((source[b] + 1) * (m + 10_000))))
    out = []
    for i, t in rows:
        w, f = features(t)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return collections.Counter(map(tuple, out))


@pytest.mark.parametrize(("percent", "sizes"), [(5, {}), (40, {"run_rows": 7, "block_rows": 2, "bin_rows": 3}), (100, {"run_rows": 5, "block_rows": 1, "bin_rows": 1, "sample": 6})])
def test_resampling_equals_brute_force(spark, docs, texts, percent, sizes):
    rows = [*texts, *[(10**9, texts[3][1])] * 30]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(texts) :], "doc_id bigint, text string"))
    more = more.selectExpr("*", "1 AS rid", "'x' AS score", "2 AS rank", "3 AS weight")
    target = [texts[0][1], texts[1][1], None, "", "One a B c D one"]
    aims = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string")
    got = importance.resample(more, aims, percent, **sizes)
    assert collections.Counter(map(tuple, got.collect())) == resampled(rows, target, percent)


def test_resampling_equals_sql(spark, docs):
    aims = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id bigint, text string")
    same(importance.resample(docs, aims).drop("n_words"), importance.ORACLE, documents=docs.select("doc_id", "text"), benchmark=aims)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "é", "x" * 30, "Ünd", "1"]) for _ in range(500)) + " end"
    whole = features(text)
    pieces = importance._pieces
    for size in (1, 7, 64, 10**6):
        monkeypatch.setattr(importance, "_pieces", lambda blob, s=size: pieces(blob, s))
        parts = list(importance.feature_buckets(text))
        assert sorted(np.concatenate([p[1:] for p in parts])) == sorted(whole[1]) and sum(p[0] for p in parts) == len(whole[0])


def test_merge_opens_blocks_late():
    r = random.Random(5)
    runs = [sorted((r.randrange(500), 0, r.randrange(9), 0, k * 1000 + j) for j in range(r.randint(1, 200))) for k in range(40)]
    blocks = sorted((run[a : a + 8] for run in runs for a in range(0, len(run), 8)), key=lambda b: b[0])
    opened = []
    merged = importance.merge_runs(b for b in blocks if opened.append(b[0]) is None)
    want = sorted(x for run in runs for x in run)
    first = list(itertools.islice(merged, 20))
    assert first == want[:20] and len(opened) < len(blocks) / 2 and max(opened[:-1]) <= first[-1]
    assert first + list(merged) == want


# conversation repair


def cheapest(rows):
    """(cost, letters, lines) of the least repair, by trying every edit from every state."""
    seen, marked = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    memo = {}

    def best(i, done, inserted):
        """done: letters so far matter only by what may follow; at most two turns are ever inserted at one place."""
        key = i, done[-1:], len(done) > 0, inserted
        if key in memo:
            return memo[key]
        options = []
        if i == len(marked) and re.fullmatch("(s?(ua)+)?", done):
            options.append((0, "", ()))
        ways = []
        if i < len(marked):
            role, text, fault = marked[i]
            ways.append(("D", 4, done, i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if role[:1] in ("s", "u", "a"):
                    ways.append(("K", more, done + role[:1], i + 1, f"{role}:{text}"))
                ways += [("R", 3 + more, done + x[0], i + 1, f"{x}:{text}") for x in ("user", "assistant")]
        if inserted < 3:
            ways += [("I", 3, done + x[0], i, f"{x}:") for x in ("user", "assistant")]
        for letter, cost, after, j, line in ways:
            if re.fullmatch("s?(ua)*u?", after):
                c, a, lines = best(j, after, inserted + 1 if j == i else 0)
                options.append((c + cost, letter + a, ((line,) if line else ()) + lines))
        memo[key] = min(options, default=(10**9, "", ()))
        return memo[key]

    return best(0, "", 0), collections.Counter(f for *_, f in marked)


def damage(conv, turn, role, text):
    show = lambda x: " " if x is None else x
    kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
    role, text = "user" if kind == 4 else show(role), "" if kind == 1 else re.sub("[.!?]", "", show(text)) if kind == 2 else show(text)
    return [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def conversations():
    r = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "sys"]
    texts = ["Yes.", "No!", "Why?", "Cut", "And so on. \n", " ", "", None, "é.", "Yes", "a,\t"]
    for conv in [*range(400), None]:
        tidy = r.random() < 0.5
        for turn in range(r.randint(1, 7)):
            t = r.choice([turn, turn, turn * 3, None, 2])
            yield (conv, turn, ["user", "assistant"][turn % 2], f"Text {r.randrange(5)}.") if tidy else (conv, t, r.choice(roles), r.choice(texts))


def test_repair_equals_brute_force_and_sql(spark):
    rows = list(conversations())
    table = spark.createDataFrame([(*x, "y", 1, 0.5, 7) for x in rows], "conv_id bigint, turn bigint, role string, text string, fault string, n int, cost double, b0 int").repartition(5)
    got = repair.summaries(repair.repair(repair.damaged(table)))
    of = collections.defaultdict(list)
    for x in rows:
        of[x[0]] += damage(*x)
    by = {r["conv_id"]: r for r in got.collect()}
    assert len(by) == got.count() == len(of)
    for conv, kept in of.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        (cost, audit, lines), faults = cheapest([x[1:] for x in kept])
        turns = {x[0] for x in kept if x[0] is not None}
        initials = [x[1][:1] for x in kept]
        want = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert tuple(by[conv])[1:] == want, (conv, kept)
    assert any(not x for x in of.values())
    same(got, repair.ORACLE, conversations=table.select("conv_id", "turn", "role", "text"))


def test_repair_of_long_conversations(spark):
    """Thousands of copies are one step; a long conversation streams in small batches; its edits make the structure asked for."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        r = random.Random(2)
        long = [(1, k, r.choice(["user", "assistant"]), f"Turn {k}{r.choice(['.', ''])}", 1) for k in range(3000)]
        rows = long + [(2, 5, "user", "Same.", 1)] * 4000 + [(3, k // 2, "user", "Same." * 2000, 1) for k in range(200)]
        table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint").repartition(7)
        edits = repair.repair(table)
        assert edits.filter("conv_id = 2").count() == 3
        by = {x["conv_id"]: x for x in repair.summaries(edits).collect()}
        assert by[2]["audit"] == "K" + "D" * 3999 + "I" and by[2]["duplicate"] == 3999 and by[2]["cost"] == 3999 * 4 + 3
        assert by[3]["audit"] == "K" + "D" * 199 + "I"
        done = [x for x in edits.filter("conv_id = 1").collect()]
        left = [(x["role"] if x["edit"] == "K" else x["new_role"], "" if x["edit"] == "I" else x["text"]) for x in done if x["edit"] in ("K", "R", "I")]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in left))
        assert by[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{t}" for a, t in left).encode()).hexdigest()
        assert by[1]["cost"] == sum({"K": 0, "R": 3, "D": 4, "I": 3}[x["edit"]] + 3 * (x["fault"] == "truncated" and x["edit"] in ("K", "R")) for x in done)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
