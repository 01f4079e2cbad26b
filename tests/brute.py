"""Small in-memory models of matching and cleaning, for comparison on small tables only."""

from itertools import combinations


def fold(value):
    return " ".join(value.split()).lower()


def match(rows, headers, rules, max_block=1000, sample=20):
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    edges, decisions, skipped = [], [], []
    comparisons = ambiguous = 0
    by_row = {}
    for i, row in enumerate(rows):
        by_row.setdefault(tuple(row), []).append(i)
    for members in by_row.values():
        for a, b in zip(members, members[1:]):
            edges.append((a, b, 1.0))
            decisions.append((a, b, None, "duplicate", 1.0))
            comparisons += 1
    if rules is not None:
        names = [h.strip().lower() for h in headers]

        def cell(row, f):
            key = f.column_name.strip().lower()
            raw = row[names.index(key)] if key in names else ""
            return fold(raw) if f.comparison == "normalized_exact" else raw

        heaviest = max(rules.fields, key=lambda f: f.weight)
        blocks = {}
        for members in by_row.values():
            key = heaviest.column_name.strip().lower()
            raw = rows[members[0]][names.index(key)] if key in names else ""
            if fold(raw):
                blocks.setdefault(fold(raw), []).append(members[0])
        for key in sorted(blocks):
            block = sorted(blocks[key])
            if len(block) > max_block:
                skipped.append((key, len(block), block[:sample]))
                continue
            for a, b in combinations(block, 2):
                comparisons += 1
                total = hit = 0.0
                for f in rules.fields:
                    total += f.weight
                    hit += f.weight if cell(rows[a], f) == cell(rows[b], f) else 0.0
                score = hit / total
                if score >= rules.duplicate_threshold:
                    edges.append((a, b, score))
                    decisions.append((a, b, key, "duplicate", score))
                elif score >= rules.review_threshold:
                    ambiguous += 1
                    decisions.append((a, b, key, "ambiguous", score))
    for a, b, _ in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    groups = {k: v for k, v in groups.items() if len(v) > 1}
    scores = {k: min(s for a, _, s in edges if find(a) == k) for k in groups}
    return {
        "decisions": decisions,
        "groups": {k: (len(v), scores[k]) for k, v in groups.items()},
        "members": {(k, i) for k, v in groups.items() for i in v},
        "skipped": skipped,
        "comparisons": comparisons,
        "duplicates": len(edges),
        "ambiguous": ambiguous,
    }
