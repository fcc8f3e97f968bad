"""The prefix trie against dictionaries of prefixes, merges of small blocks, odd rows."""

import hashlib
import math
import random
import re
import zlib

from sonoframe.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    nodes, kids = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        under = kids.get(k, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[u] for u in under) or 1
        saved[k] = (len(nodes[k]) - 1) * words + sum(saved[u] for u in under)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=str)


def test_given_conversations_copies_and_odd_rows(spark, sf):
    rows = [(-1, 0, "a", "x"), (-1, 0, "a", "x"), (-1, None, None, None), (-20, 1, "a", "q"), (-21, 1, "a", "q z"), (None, 1, "a", "b"), (-41, 1, "", ""), (-41, 2, "aq", ""), (-42, 1, "a", "q")]
    rows += [(10_000 + i, t, "user", f"hi {t}") for i in range(300) for t in range(5)]
    rows += [(20_000, t, "u", f"w {t} a b") for t in range(300)] + [(20_001, t, "u", f"w {t} a b") for t in range(299)]
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(rows, COLUMNS))
    assert found(df) == plain([tuple(r) for r in df.collect()])


def test_empty_table_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], COLUMNS)) == []
    clash = spark.createDataFrame([(1, 0, "a", "b", 5, 6)], COLUMNS + ", base int, key int")
    assert found(clash) == plain([(1, 0, "a", "b")])


def test_runs_of_small_blocks_merge_into_cut_nodes():
    rng = random.Random(3)
    for trial in range(40):
        letters = [bytes([65 + i]) * prefix_trie.KEY for i in range(rng.choice([1, 2, 4]))]
        rows = []
        for i in range(rng.randrange(1, 80)):
            turns = [rng.choice(letters) for _ in range(rng.randrange(0, 6))]
            rows.append((b"".join(turns), i, [1 + t[0] % 3 for t in turns]))
        ordered = sorted(rows)
        cuts = sorted({ordered[rng.randrange(len(ordered))][:2] for _ in range(trial % 5)})
        by_range = {}
        runs = [[] for _ in range(1 + trial % 4)]
        for row in rows:
            rng.choice(runs).append(row)
        for run in runs:
            for block in prefix_trie.run_blocks(run, cuts, most=1 + trial % 3):
                for d in block.to_pylist():
                    by_range.setdefault(d["range"], []).append(d)
        places = sorted(by_range)
        streams = {}
        for place in places:
            blocks = sorted(by_range[place], key=lambda d: (d["need"] is not None, d["need"] or b"", d["need_id"] or 0))
            streams[place] = list(prefix_trie.merged(iter(blocks)))
        merged = [m for place in places for m in streams[place]]
        assert [(seq, key, words) for key, seq, words, _ in merged] == ordered
        for place in places:
            for one, two in zip(streams[place], streams[place][1:], strict=False):
                assert two[3] == prefix_trie.common(one[1], two[1])
        whole, cut = {}, {}
        for i, place in enumerate(places):
            before = streams[places[i - 1]][-1][1] if i else None
            after = streams[places[i + 1]][0][1] if i + 1 < len(places) else None
            for _, depth, least, n, children, leaves, shared, base, ends, key, ids in prefix_trie.nodes_of(iter(streams[place]), before, after):
                if key is None:
                    whole[(least, depth)] = (n, children, leaves, shared - (n - 1) * base, ends)
                else:
                    c = cut.setdefault(key, [depth, least, 0, 0, 0, 0, base, []])
                    c[1] = min(c[1], least)
                    for j, v in enumerate((n, children, leaves, shared)):
                        c[2 + j] += v
                    c[7] += [ids] if ids else []
        for depth, least, n, children, leaves, shared, base, ids in cut.values():
            whole[(least, depth)] = (n, children, leaves, shared - (n - 1) * base, hashlib.sha256(",".join(ids).encode()).hexdigest())
        nodes = {}
        for seq, i, _ in rows:
            for d in range(len(seq) // prefix_trie.KEY + 1):
                nodes.setdefault(seq[: d * prefix_trie.KEY], []).append(i)
        assert len(whole) == len(nodes)
        words = {k: 1 + k[-1] % 3 if k else 0 for k in nodes}
        for k, members in nodes.items():
            under = [u for u in nodes if u.startswith(k)]
            n, children, leaves, saved, ends = whole[(min(members), len(k) // prefix_trie.KEY)]
            assert n == len(members) and children == sum(len(u) == len(k) + prefix_trie.KEY for u in under)
            assert leaves == sum(not any(v != u and v.startswith(u) for v in under) for u in under)
            assert saved == sum((len(nodes[u]) - 1) * words[u] for u in under)
            assert ends == hashlib.sha256(",".join(str(i) for seq, i, _ in sorted(rows) if seq == k).encode()).hexdigest()
