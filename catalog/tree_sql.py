"""SQL texts that grow trees, forests and boosted trees on the embedding matrix, as an independent check of the learners."""

from __future__ import annotations

from catalog.base import with_inputs

#: splits are compared to nine places; the cuts are 254 quantiles of the training rows
BINS, MASK = 255, (1 << 64) - 1
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * FIRST) & MASK
    x = ((x ^ (x >> 27)) * SECOND) & MASK
    return x ^ (x >> 31)


def draw_columns(name: str, constants: tuple[int, ...], *parts: str) -> str:
    """Columns that end in ``name``, a number in (0, 1) by a hash of the constants and the (BIGINT) parts."""
    state = 0
    for c in constants:
        state = _mixed(((state ^ c) + GOLDEN) & MASK)
    last, out = f"{state}::UHUGEINT", []
    for i, part in enumerate(parts):
        a, b, c = (f"_{name}{i}{k}" for k in "abc")
        out.append(f"(xor({last}, ({part})::UHUGEINT) + {GOLDEN}::UHUGEINT) & {MASK}::UHUGEINT AS {a}")
        out.append(f"(xor({a}, {a} >> 30) * {FIRST}::UHUGEINT) & {MASK}::UHUGEINT AS {b}")
        out.append(f"(xor({b}, {b} >> 27) * {SECOND}::UHUGEINT) & {MASK}::UHUGEINT AS {c}")
        last = f"xor({c}, {c} >> 31)"
    return ", ".join(out) + f", (({last} >> 11)::BIGINT::DOUBLE + 0.5) / 9007199254740992::DOUBLE AS {name}"


class Grower:
    """Collects the steps of a query; ``d`` has all rows (key, y, train, row) and ``cells`` their features with the smallest cut above each value."""

    def __init__(self, source: str, n_classes: int):
        self.n = n_classes
        self.steps: dict[str, str] = {}
        self.source = source
        self.add("numbered", "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key), key) AS rn, count(*) OVER (PARTITION BY label) AS nc FROM m")
        self.add("d", "SELECT key, label AS y, features, rn > round(0.2::DOUBLE * nc) AS train, ('0x' || substr(md5(key), 1, 15))::BIGINT AS row FROM numbered")
        self.add("long", "SELECT key, train, generate_subscripts(features, 1)::INT - 1 AS f, unnest(features)::DOUBLE AS x FROM d")
        self.add(
            "edges",
            f"""SELECT DISTINCT f, x AS e FROM (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS rn, count(*) OVER (PARTITION BY f) AS n FROM long WHERE train) o
            JOIN (SELECT unnest(range(1, {BINS})) AS i) i ON rn = ceil(i::DOUBLE / {BINS} * n)""",
        )
        self.add("cells", "SELECT l.key, l.f, e.e FROM long l ASOF LEFT JOIN edges e ON l.f = e.f AND l.x <= e.e")

    def add(self, name: str, sql: str) -> str:
        self.steps[name] = sql
        return name

    def grow(self, name: str, rows: str, sums: list[str], score: str, unit: str, allowed: str, depth: int, gamma: float = 0.0, least: int = 2, subset: int = 0, seed: int = 42) -> str:
        """Nodes of the rows ``(t, key, train, c, *sums)`` after ``depth`` levels; ``score`` and ``allowed`` are texts over ``{sum}`` names."""
        fill = lambda text, suffix: text.format(**{c: f"{c}{suffix}" for c in [*sums, "c"]})
        now = self.add(f"{name}0", f"SELECT *, 1::BIGINT AS node FROM {rows}")
        names = [*sums, "c"]
        for level in range(depth):
            p = f"{name}{level}"
            self.add(f"{p}h", f"SELECT t, node, f, e, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM {now} JOIN cells USING (key) WHERE train AND c > 0 GROUP BY t, node, f, e")
            tried = ""
            if subset:
                self.add(f"{p}u", f"SELECT t, node, f, {draw_columns('u', (seed, 3), 't', 'node', 'f')} FROM (SELECT DISTINCT t, node, f FROM {p}h)")
                self.add(f"{p}f", f"SELECT t, node, f FROM (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY u, f) AS k FROM {p}u) WHERE k <= {subset}")
                tried = f"JOIN {p}f USING (t, node, f)"
            running = ", ".join(f"sum({c}) OVER (PARTITION BY t, node, f ORDER BY e NULLS LAST) AS {c}_l, sum({c}) OVER (PARTITION BY t, node, f) AS {c}_t" for c in names)
            self.add(f"{p}c", f"SELECT *, {', '.join(f'{c}_t - {c}_l AS {c}_r' for c in names)} FROM (SELECT t, node, f, e, {running} FROM {p}h {tried})")
            gain = f"round(({fill(score, '_l')} + {fill(score, '_r')} - {fill(score, '_t')} - {gamma}::DOUBLE) / ({fill(unit, '_t')}), 9)"
            self.add(
                f"{p}b",
                f"""SELECT t, node, f, e FROM (SELECT t, node, f, e, row_number() OVER (PARTITION BY t, node ORDER BY g DESC, f, e) AS k FROM (
                SELECT t, node, f, e, {gain} AS g FROM {p}c WHERE e IS NOT NULL AND c_r > 0 AND c_t >= {least} AND {fill(allowed, '_l')} AND {fill(allowed, '_r')}) WHERE g > 0) WHERE k = 1""",
            )
            now = self.add(
                f"{name}{level + 1}",
                f"""SELECT n.* REPLACE (CASE WHEN b.f IS NULL THEN n.node ELSE 2 * n.node + coalesce(x.e > b.e, true)::BIGINT END AS node)
                FROM {now} n LEFT JOIN {p}b b ON b.t = n.t AND b.node = n.node LEFT JOIN cells x ON x.key = n.key AND x.f = b.f""",
            )
        return now

    def text(self, body: str) -> str:
        steps = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in self.steps.items())
        # the inputs come first; steps may use them
        inner = with_inputs(f"SELECT * FROM m", m=self.source)
        return f"WITH m AS MATERIALIZED ({inner}), {steps} {body}"


def predictions(grower: Grower, shares: list[str], source: str) -> str:
    """Test rows with rounded class shares and the first of the likeliest classes."""
    rounded = [f"round({p}, 6) AS p{c}" for c, p in enumerate(shares)]
    likeliest = "CASE " + " ".join(f"WHEN p{c} = greatest({', '.join(f'p{k}' for k in range(len(shares)))}) THEN {c}" for c in range(len(shares))) + " END"
    columns = ", ".join(f"p{c}" for c in range(len(shares)))
    return grower.text(f"SELECT key, y AS y_true, {likeliest}::INT AS y_pred, {columns} FROM (SELECT key, y, {', '.join(rounded)} FROM {source} WHERE NOT train)")


def tree_sql(source: str, n_classes: int = 2, depth: int = 6, criterion: str = "gini", balanced: bool = False, trees: int = 0, subset: int = 0) -> str:
    """A tree, or the mean of ``trees`` bootstrapped ones that try ``subset`` features per node."""
    g = Grower(source, n_classes)
    classes = range(n_classes)
    factor = f"(SELECT count(*) FILTER (train) FROM d) / ({n_classes}.0::DOUBLE * (SELECT count(*) FROM d b WHERE b.train AND b.y = a.y))" if balanced else "1.0::DOUBLE"
    if trees:
        # counts by inversion of the Poisson distribution with mean one
        poisson = [sum(2.718281828459045**-1 / _factorial(j) for j in range(k + 1)) for k in range(12)]
        count = " + ".join(f"(u > {p!r}::DOUBLE)::INT" for p in poisson)
        g.add("drawn", f"SELECT key, y, train, t, {draw_columns('u', (42, 1), 't', 'row')}, ({count})::DOUBLE AS c FROM d, (SELECT unnest(range({trees})) AS t) t")
    else:
        g.add("drawn", "SELECT key, y, train, 0::BIGINT AS t, 1.0::DOUBLE AS c FROM d")
    g.add("start", f"SELECT a.t, a.key, a.y, a.train, a.c, {', '.join(f'CASE WHEN y = {k} THEN c * {factor} ELSE 0 END AS w{k}' for k in classes)} FROM drawn a")
    sums = [f"w{k}" for k in classes]
    total = " + ".join(f"{{w{k}}}" for k in classes)
    if criterion == "gini":
        score = "((" + " + ".join(f"{{w{k}}} * {{w{k}}}" for k in classes) + f") / ({total}))"
    else:
        log = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"
        score = "(" + " + ".join(log(f"{{w{k}}}") for k in classes) + f" - {log(total)})"
    now = g.grow("n", "start", sums, score, total, "{c} >= 1", depth, subset=subset)
    g.add("leaves", f"SELECT t, node, {', '.join(f'sum(w{k}) AS v{k}' for k in classes)} FROM {now} WHERE train GROUP BY t, node")
    whole = " + ".join(f"v{k}" for k in classes)
    g.add("scored", f"SELECT key, any_value(y) AS y, any_value(train) AS train, {', '.join(f'avg(v{k} / ({whole})) AS a{k}' for k in classes)} FROM {now} JOIN leaves USING (t, node) GROUP BY key")
    return predictions(g, [f"a{k}" for k in classes], "scored")


def _factorial(n: int) -> int:
    return 1 if n < 2 else n * _factorial(n - 1)


def boosting_sql(source: str, n_classes: int = 2, rounds: int = 3, depth: int = 3, rate: float = 0.1, l2: float = 0.0, l1: float = 0.0, gamma: float = 0.0, hessian: float = 0.0, leaf: int = 1) -> str:
    """Newton boosting of the logistic loss, or of the softmax loss with a tree per class and round."""
    g = Grower(source, n_classes)
    outputs = range(1 if n_classes == 2 else n_classes)
    share = lambda k: f"(SELECT avg((y = {k})::INT) FROM d WHERE train)"
    starts = [f"ln({share(1)} / {share(0)})"] if n_classes == 2 else [f"ln({share(k)})" for k in outputs]
    now = g.add("margin0", f"SELECT key, y, train, {', '.join(f'{s} AS z{k}' for k, s in zip(outputs, starts))} FROM d")
    soft = f"(sign({{g}}) * greatest(abs({{g}}) - {l1}::DOUBLE, 0))"
    score = f"(0.5::DOUBLE * {soft} * {soft} / ({{h}} + {l2}::DOUBLE))"
    allowed = f"{{c}} >= {leaf} AND {{h}} >= {max(hessian, 1e-12)!r}::DOUBLE"
    for i in range(rounds):
        if n_classes == 2:
            body = f"SELECT 0::BIGINT AS t, key, y, train, 1.0::DOUBLE AS c, 1 / (1 + exp(-z0)) AS p, (y = 1)::INT AS own FROM {now}"
        else:
            whole = " + ".join(f"exp(z{k})" for k in outputs)
            body = " UNION ALL ".join(f"SELECT {k}::BIGINT AS t, key, y, train, 1.0::DOUBLE AS c, exp(z{k}) / ({whole}) AS p, (y = {k})::INT AS own FROM {now}" for k in outputs)
        g.add(f"r{i}", f"SELECT t, key, y, train, c, p - own AS g, greatest(p * (1 - p), 1e-16::DOUBLE) AS h FROM ({body})")
        ends = g.grow(f"r{i}n", f"r{i}", ["g", "h"], score, "{h} + abs({g})", allowed, depth, gamma, max(2, 2 * leaf))
        value = f"-{rate}::DOUBLE * {soft.format(g='sum(g)')} / (sum(h) + {l2}::DOUBLE)"
        g.add(f"r{i}v", f"SELECT t, node, {value} AS v FROM {ends} WHERE train GROUP BY t, node")
        g.add(f"r{i}z", f"SELECT key, {', '.join(f'max(v) FILTER (t = {k}) AS v{k}' for k in outputs)} FROM {ends} JOIN r{i}v USING (t, node) GROUP BY key")
        now = g.add(f"margin{i + 1}", f"SELECT key, y, train, {', '.join(f'z{k} + v{k} AS z{k}' for k in outputs)} FROM {now} JOIN r{i}z USING (key)")
    if n_classes == 2:
        return predictions(g, ["1 - 1 / (1 + exp(-z0))", "1 / (1 + exp(-z0))"], now)
    whole = " + ".join(f"exp(z{k})" for k in outputs)
    return predictions(g, [f"exp(z{k}) / ({whole})" for k in outputs], now)


def looped_boosting_sql(source: str, rounds: int, depth: int, rate: float, l2: float = 0.0, hessian: float = 0.0, leaf: int = 1) -> str:
    """Newton boosting of the logistic loss over any number of rounds: a recursive step grows the tree of a round, so the text does not grow with them."""
    g = Grower(source, 2)
    share = lambda k: f"(SELECT avg((y = {k})::INT) FROM d WHERE train)"
    g.add("ids", "SELECT *, row_number() OVER (ORDER BY key)::INT AS id FROM d")
    g.add("places", "SELECT id, c.f, dense_rank() OVER (PARTITION BY c.f ORDER BY e NULLS LAST)::INT AS b, e IS NULL AS beyond FROM cells c JOIN ids USING (key)")
    g.add("seen", "SELECT id, f, b, beyond FROM places JOIN ids USING (id) WHERE train")
    g.add("begun", f"SELECT 0 AS i, id, y, train, ln({share(1)} / {share(0)}) AS z FROM ids")
    outer, g.steps = g.steps, {}
    score = lambda grad, hess: f"(0.5::DOUBLE * ({grad}) * ({grad}) / ({hess} + {l2}::DOUBLE))"
    least, wide = f"{max(hessian, 1e-12)!r}::DOUBLE", 1 << 16
    gain = f"round(({score('gl', 'hl')} + {score('gt - gl', 'ht - hl')} - {score('gt', 'ht')}) / (ht + abs(gt)), 9)"
    allowed = f"NOT beyond AND cl >= {leaf} AND ct - cl >= {max(1, leaf)} AND hl >= {least} AND ht - hl >= {least}"
    g.add("n0", f"SELECT i, id, y, train, z, p - y AS g, greatest(p * (1 - p), 1e-16::DOUBLE) AS h, 1::BIGINT AS node FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM rounds WHERE i < {rounds})")
    for level in range(depth):
        now, totals, cuts, best = (f"{c}{level}" for c in "ntcb")
        g.add(totals, f"SELECT node, sum(g) AS gt, sum(h) AS ht, count(*) AS ct FROM {now} WHERE train GROUP BY node HAVING count(*) >= {max(2, 2 * leaf)}")
        held = f"SELECT node * {wide} + f AS k, b, beyond, g, h FROM {now} JOIN seen USING (id) WHERE node IN (SELECT node FROM {totals})"
        g.add(cuts, f"SELECT k // {wide} AS node, k % {wide} AS f, b, beyond, sum(g) OVER w AS gl, sum(h) OVER w AS hl, count(*) OVER w AS cl FROM ({held}) WINDOW w AS (PARTITION BY k ORDER BY b)")
        g.add(best, f"SELECT node, arg_min((f, b), (-q, f, b)) AS cut FROM (SELECT node, f, b, {gain} AS q FROM {cuts} JOIN {totals} USING (node) WHERE {allowed}) WHERE q > 0 GROUP BY node")
        moved = "CASE WHEN s.node IS NULL THEN n.node ELSE 2 * n.node + (x.b > s.cut[2])::BIGINT END AS node"
        g.add(f"n{level + 1}", f"SELECT n.* REPLACE ({moved}) FROM {now} n LEFT JOIN {best} s ON s.node = n.node LEFT JOIN places x ON x.id = n.id AND x.f = s.cut[1]")
    ends = f"n{depth}"
    g.add("steps", f"SELECT node, -{rate}::DOUBLE * sum(g) / (sum(h) + {l2}::DOUBLE) AS v FROM {ends} WHERE train GROUP BY node")
    inner = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in g.steps.items())
    g.steps = outer
    g.add("rounds", f"SELECT * FROM begun UNION ALL (WITH {inner} SELECT i + 1, id, y, train, z + v FROM {ends} JOIN steps USING (node))")
    g.add("last", f"SELECT key, r.y, r.train, z FROM rounds r JOIN ids USING (id) WHERE i = {rounds}")
    return predictions(g, ["1 - 1 / (1 + exp(-z))", "1 / (1 + exp(-z))"], "last").replace("WITH m AS", "WITH RECURSIVE m AS", 1)
