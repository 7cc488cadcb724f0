"""Plain versions of operators that SQL cannot express, written apart from the library."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from verdict.llm.unigram import decode, encode
from verdict.llm.url_filter import judge_urls


def plain_ids(path, text, unknown=10.0):
    """Viterbi over the whole text; of equal scores the longest last piece."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    piece = {p.piece: (p.score, i) for i, p in enumerate(m.pieces) if p.type in (1, 4)}
    byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
    longest, worst = max(map(len, piece)), min(s for s, _ in piece.values()) - unknown
    x = "▁" + text.replace(" ", "▁") if text else ""
    best, take = [0.0] + [-math.inf] * len(x), [0] * (len(x) + 1)
    for p in range(1, len(x) + 1):
        for k in range(1, min(p, longest) + 1):
            s = piece[x[p - k:p]][0] if x[p - k:p] in piece else worst if k == 1 else -math.inf
            if s > -math.inf and best[p - k] + s >= best[p]:
                best[p], take[p] = best[p - k] + s, k
    out, p = [], len(x)
    while p:
        word = x[p - take[p]:p]
        out = ([piece[word][1]] if word in piece else [byte[b] for b in word.encode()]) + out
        p -= take[p]
    return out


def test_ids_do_not_depend_on_chunks(spark):
    import public_tokenizers
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    texts = [None, "", " ", "a" * 301, "ab" * 260, "=" * 400, "\n" * 333, "日本語" * 90, "aaaa bbbb " * 40, "-" * 127 + "_" * 90]
    texts += ["".join(rng.choice("aaab=-\n1é") for _ in range(rng.choice([90, 250, 700]))) for _ in range(25)]
    texts += ["".join(rng.choice(["ss", "the", "ing", " ", "tion", "一"]) for _ in range(150)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, i, "x", i) for i, t in enumerate(texts)],
                                 "doc_id long, text string, uid long, _uid string, `row.text` long")
    want = {i: plain_ids(path, t) for i, t in enumerate(texts)}
    for settings in ({}, {"giant": 40, "chunk": 16, "fan": 2}, {"giant": 100, "chunk": 37, "fan": 3}, {"giant": 60, "chunk": 60, "fan": 64}):
        rows = decode(encode(docs, path, **settings), path).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id], (settings, texts[r.doc_id])
            assert r.decoded == (texts[r.doc_id] or "") and (r.uid, r._uid, r["row.text"]) == (r.doc_id, "x", r.doc_id)


def spark_hash(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_templates(rows, depth=8, least=16, ratio=0.2, alpha=0.05, weight=8.0):
    """{(host, segments): (template, share)} of (host, segments, label) rows."""
    count = defaultdict(lambda: [0, 0, 0])
    for host, segs, label in rows:
        for j, x in enumerate((True, label == 1, label == 0)):
            count[host, segs][j] += x
    template = {key: key[1] for key in count}
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    for level in range(1, max(map(len, template.values()), default=0) + 1):
        kids = defaultdict(lambda: [0, 0, 0, Counter()])
        for (host, segs), t in template.items():
            if len(t) >= level:
                k = kids[host, t[:level - 1], t[level - 1]]
                for j in range(3):
                    k[j] += count[host, segs][j]
                k[3][segs[level:]] += count[host, segs][0]
        nodes, pools = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        main = {key: max(k[3], key=lambda s: (k[3][s], spark_hash(s))) for key, k in kids.items()}
        for (host, node, child), k in kids.items():
            nodes[host, node][0] += 1
            nodes[host, node][1] += k[0]
            pools[host, node, main[host, node, child]][0] += k[1]
            pools[host, node, main[host, node, child]][1] += k[2]
        variable = {n for n, (c, urls) in nodes.items() if c >= least and c >= ratio * urls}
        together, name = defaultdict(list), {}
        for (host, node, child), k in kids.items():
            bad, good = pools[host, node, main[host, node, child]]
            seen, pool = k[1] + k[2], bad + good
            own = bool(seen) and abs(k[1] / seen - bad / pool) > bound * (1 / math.sqrt(seen) + 1 / math.sqrt(pool))
            name[host, node, child] = "*" if (host, node) in variable else child
            if (host, node) not in variable and not own:
                together[host, node, main[host, node, child]].append(child)
        for (host, node, _), group in together.items():
            for child in group if len(group) > 1 else ():
                name[host, node, child] = "~" + min(group)
        for (host, segs), t in template.items():
            if len(t) >= level:
                template[host, segs] = (*t[:level - 1], name[host, t[:level - 1], t[level - 1]], *t[level:])
    by_host, by_template, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for key, (_, bad, good) in count.items():
        for sums in (by_host[key[0]], by_template[key[0], template[key]], total):
            sums[0] += bad
            sums[1] += good
    prior = (total[0] + 1) / (sum(total) + 2)

    def smooth(s, p):
        return (s[0] + weight * p) / (sum(s) + weight)

    return {key: (t, smooth(by_template[key[0], t], smooth(by_host[key[0]], prior))) for key, t in template.items()}


def test_template_tree_and_verdicts(spark):
    rng = random.Random(11)
    hosts = ["a.com", "b.a.com", "c.net"]
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(
        rng.choice([f"s{rng.randrange(60)}x", rng.choice("pqr"), "ads", "news", f"{rng.randrange(9)}"]) for _ in range(rng.randrange(1, 5)))
        for _ in range(1500)]
    urls += [f"http://c.net/ads/x{i}y/" + "z" * (i % 3) for i in range(200)]
    deep = "/".join("abcdefgh")
    urls += [f"http://d.org/{deep}/i/{t}" for t in ("good", "bad")] * 40 + [f"http://d.org/{deep}", f"http://d.org/{deep}/i", "http://d.org//a//"]
    urls += [f"http://e.org/{deep}/{i}v/{'ads' if i % 2 else 'news'}" for i in range(60)]
    urls += ["http://f.com/" + "/".join("t" * 5000)]
    rules = [("a.com", "/ads", "block"), ("c.net", "/ads/x1", "block"), ("c.net", "/news", "allow"), ("b.a.com", "/p", "allow"),
             ("d.org", f"/{deep}/i/b", "block"), ("d.org", f"/{deep}/i/g", "allow")]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(rows) == len(urls)
    import re
    judged, segments = {}, {}
    for i, url in enumerate(urls):
        host, _, path = url[7:].partition("/")
        path = "/" + path
        parts = [re.sub("[0-9]+", "{n}", re.sub("[0-9a-fA-F]{16,}", "{h}", s)) for s in path.split("/")[1:]]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        judged[i] = max(fits, key=lambda x: len(x[0] + x[1]), default=(None, None, None))[2]
        segments[i] = host, tuple(parts[:8] + (["/".join(parts[8:])] if len(parts) > 8 else []))
    plain = plain_templates([(*segments[i], {"block": 1, "allow": 0}.get(judged[i])) for i in judged])
    unruled = set()
    for r in rows:
        t, share = plain[segments[r.page_id]]
        assert r.template == "/" + "/".join(t) and r.share == pytest.approx(share, abs=1e-12)
        method = "block" if r.share >= 0.8 else "allow"
        assert r.verdict == (judged[r.page_id] or method)
        unruled |= {method} if judged[r.page_id] is None else set()
    assert unruled == {"block", "allow"}
    good, bad = (plain["d.org", (*"abcdefgh", f"i/{t}")] for t in ("good", "bad"))   # ten segments: no common template
    assert good[0] != bad[0] and good[1] < bad[1]


def test_rules_of_equal_length_and_repeated_pages(spark):
    urls = ["http://x.com/a/b", "http://x.com/a/b", "http://x.com/a", None]
    rows = judge_urls(spark.createDataFrame([(1, u) for u in urls], "page_id long, url string"),
                      [("x.com", "/a", "block"), ("com", "/a/b", "allow"), ("x.com", "/a/", "allow")]).collect()
    assert sorted((r.path, r.rule or "", r.verdict) for r in rows) == [
        ("", "", "allow"), ("/a", "x.com/a", "block"), ("/a/b", "x.com/a/", "allow"), ("/a/b", "x.com/a/", "allow")]
