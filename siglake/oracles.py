"""SQL for queries whose formulas are long: written out from the definitions, stage by stage, as common table expressions.

Each entry of TEXTS is (SQL, names of the catalogue's prelude tables that it needs).
"""

from __future__ import annotations

import math
from itertools import count

from siglake.functions import wavelets

TEXTS: dict[str, tuple[str, str]] = {}


def materialized(stages: list[tuple[str, str]], last: str) -> str:
    """One query of named stages; each is worked out once."""
    return "with " + ", ".join(f"{name} as materialized ({sql})" for name, sql in stages) + " " + last


# -- wavelet packets -------------------------------------------------------------------------------------------------------


def taps_of(family: str) -> dict[str, list[float]]:
    """Analysis filters: the high one alternates the signs of the other side's reversed low one."""
    if family in wavelets.ORTHOGONAL:
        low = back = wavelets.ORTHOGONAL[family]
    else:
        low, back = wavelets.BIORTHOGONAL[family]
    return {"l": list(low), "h": [v * (-1) ** k for k, v in enumerate(reversed(back))]}


def _taps_table(names: list[str]) -> str:
    rows = [f"('{f}', '{letter}', {t}, {w!r}::double, {len(taps)})" for f in names for letter, taps in taps_of(f).items() for t, w in enumerate(taps)]
    return "select * from (values " + ", ".join(rows) + ") v(family, letter, t, w, m)"


def packet_stages(shape: tuple[int, ...], level: int, chosen: str, names: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Stages of a packet tree of tensors `emb`, and the tables of its nodes by level: (sid, path, x0.., n0.., v).

    chosen: a table (sid, axis, family) that all nodes are split by. A position p meets tap t in
    place p + t of the whole convolution; of its middle part every second place is kept.
    """
    d = len(shape)
    place, rest = [], "idx"
    for n in reversed(shape):
        place.insert(0, f"({rest}) % {n}")
        rest = f"({rest}) // {n}"
    root = ", ".join([f"{p} as x{a}" for a, p in enumerate(place)] + [f"{n} as n{a}" for a, n in enumerate(shape)])
    stages = [("taps", _taps_table(names)), ("root", f"select sid, '' as path, '' as own, {root}, v from emb")]
    levels = ["root"]
    for k in range(level):
        now = levels[-1]
        before = f"(select * replace ('' as own) from {now})"
        for axis in range(d):
            start = f"(least(n{axis}, m) - 1) // 2"
            size = f"(greatest(n{axis}, m) + 1) // 2"
            keys = ", ".join(["c.sid", "path", "own || letter as own"] + [f"x{a}" for a in range(d) if a != axis] + [f"n{a}" for a in range(d) if a != axis])
            moved = f"(x{axis} + t - {start})"
            sql = f"select {keys}, {moved} // 2 as x{axis}, {size} as n{axis}, sum(v * w) as v from {before} c join {chosen} f on f.sid = c.sid and f.axis = {axis} join taps on taps.family = f.family where {moved} >= 0 and {moved} % 2 = 0 and {moved} // 2 < {size} group by all"
            name = f"s{k}_{axis}"
            stages.append((name, sql))
            before = name
        stages.append((f"level{k}", f"select * replace (case when path = '' then own else path || '/' || own end as path) from {before}"))
        levels.append(f"level{k}")
    return stages, levels


def _flattened(table: str, d: int) -> str:
    k = "0"
    for a in range(d):
        k = f"({k}) * n{a} + x{a}"
    return f"select sid as tid, path, {k} as k, v from {table}"


def packets(shape: tuple[int, ...], level: int = 1, family: str | tuple[str, ...] = "haar") -> str:
    d = len(shape)
    per_axis = [family] * d if isinstance(family, str) else list(family)
    fixed = "select sid, axis, family from (select distinct sid from emb), (values " + ", ".join(f"({a}, '{f}')" for a, f in enumerate(per_axis)) + ") v(axis, family)"
    stages, levels = packet_stages(shape, level, "chosen", sorted(set(per_axis)))
    return materialized([("chosen", fixed), *stages], " union all ".join(_flattened(t, d) for t in levels))


def _scores(shape: tuple[int, ...], block: tuple[int, ...], names: list[str], local: bool) -> list[tuple[str, str]]:
    """Stages that end with scores(sid, axis, family, score): low over high energy of the mean profiles of blocks, summed with one more than the block's mean step."""
    d = len(shape)
    corners = ", ".join(f"x{a} // {b} as c{a}" for a, b in enumerate(block))
    c = ", ".join(f"c{a}" for a in range(d))
    order = ", ".join(f"x{a}" for a in range(d))
    stages = [("parts", f"select *, {corners} from root")]
    stages.append(("steps", f"select sid, {c}, 1 + coalesce(avg(abs(step)), 0) as g from (select *, v - lag(v) over (partition by sid, {c} order by {order}) as step from parts) group by all"))
    found = []
    for a in range(d):
        stages.append((f"profile{a}", f"select sid, {c}, x{a} - c{a} * {block[a]} as p, avg(v) as v from parts group by all"))
        size = min(block[a], shape[a])
        moved = f"(p + t - (least({size}, m) - 1) // 2)"
        stages.append((f"energy{a}", f"select sid, {c}, family, letter, sum(v * v) as e from (select sid, {c}, family, letter, {moved} // 2 as q, sum(v * w) as v from profile{a}, taps where {moved} >= 0 and {moved} % 2 = 0 and {moved} // 2 < (greatest({size}, m) + 1) // 2 group by all) group by all"))
        found.append(f"select sid, {c}, family, {a} as axis, sum(e) filter (where letter = 'l') / (sum(e) filter (where letter = 'h') + 1e-12) as score from energy{a} group by all")
    weight = "g" if local else "1"
    return [*stages, ("scores", f"select sid, axis, family, sum(score * {weight}) as score from ({' union all '.join(found)}) join steps using (sid, {c}) group by all")]


def chosen_packets(shape: tuple[int, ...], names: list[str], block: tuple[int, ...] | None, score: str = "score", weights: str = "") -> str:
    """Packets of one level whose families have the best score, the first of equals; block: None for the whole tensor."""
    d = len(shape)
    stages, levels = packet_stages(shape, 1, "chosen", names)
    rank = "case family " + " ".join(f"when '{f}' then {k}" for k, f in enumerate(names)) + " end"
    scored = _scores(shape, block or shape, names, block is not None)
    best = f"select sid, axis, arg_max(family, (s, -{rank})) as family from (select scores.*, {score} as s from scores {weights}) group by all"
    return materialized([*stages[:2], *scored, ("chosen", best), *stages[2:]], " union all ".join(_flattened(t, d) for t in levels))


def _cost(names: list[str], of) -> str:
    return "case family " + " ".join(f"when '{f}' then {of(f)!r}" for f in names) + " end"


def _both(f: str) -> list[list[float]]:
    return [wavelets.ORTHOGONAL[f], wavelets.ORTHOGONAL[f]] if f in wavelets.ORTHOGONAL else [list(x) for x in wavelets.BIORTHOGONAL[f]]


def _axis_changes(shape: tuple[int, ...]) -> str:
    """Weights (sid, axis, aw): three steps towards axes along which the tensor changes more."""
    d = len(shape)
    parts = []
    for a in range(d):
        others = ", ".join(f"x{b}" for b in range(d) if b != a)
        parts.append(f"select sid, {a} as axis, coalesce(avg(abs(s)), 0) as ch from (select sid, v - lag(v) over (partition by sid, {others} order by x{a}) as s from root) group by sid")
    scaled = f"select sid, axis, ch / greatest(max(ch) over (partition by sid), 1e-12) as ch from ({' union all '.join(parts)})"
    step = f"select sid, axis, ch - avg(ch) over (partition by sid) as g from ({scaled})"
    return f"select sid, axis, greatest(greatest(greatest(1 + 0.1 * g, 0.1) + 0.1 * g, 0.1) + 0.1 * g, 0.1) as aw from ({step})"


_S5, _TWO = (2, 2, 2, 2, 4), ["haar", "db2"]
TEXTS["wavelet_packet_1d"] = packets((64,), 3, "db4"), "emb"
TEXTS["wavelet_packet_2d"] = packets((8, 8), 2), "emb"
TEXTS["wavelet_packet_3d"] = packets((4, 4, 4), 1, ("haar", "db2", "cdf53")), "emb"
TEXTS["wavelet_packet_4d"] = packets((2, 2, 4, 4)), "emb"
TEXTS["wavelet_packet_5d_fixed"] = TEXTS["wavelet_packet_5d_subband"] = packets(_S5), "emb"
TEXTS["wavelet_packet_5d_adaptive"] = chosen_packets(_S5, _TWO, None), "emb"
_B4, _B2 = (1, 1, 4, 4, 4), (1, 1, 2, 2, 2)
_LENGTH = _cost(_TWO, lambda f: float(sum(map(len, _both(f)))))
_ROUGH = _cost(_TWO, lambda f: float(sum(abs(q - p) for x in _both(f) for p, q in zip(x, x[1:], strict=False))))
TEXTS["wavelet_packet_5d_blockwise"] = chosen_packets(_S5, _TWO, _B4), "emb"
TEXTS["wavelet_packet_5d_regularized"] = chosen_packets(_S5, _TWO, _B4, f"score - 0.05 * {_LENGTH}"), "emb"
TEXTS["wavelet_packet_5d_multiobjective"] = chosen_packets(_S5, _TWO, _B4, f"score - 0.05 * {_LENGTH} - 0.05 * {_ROUGH}"), "emb"
TEXTS["wavelet_packet_5d_learnable"] = chosen_packets(_S5, _TWO, _B4, f"aw * score - 0.05 * {_LENGTH} - 0.05 * {_ROUGH}", f"join ({_axis_changes(_S5)}) using (sid, axis)"), "emb"
TEXTS["wavelet_packet_5d_spatial"] = TEXTS["wavelet_packet_5d_cross_branch"] = chosen_packets(_S5, _TWO, _B2), "emb"
_COSINES = """cosines as (select a.sid, a.path, b.path as other, sum(a.v * b.v) / greatest(sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)), 1e-12) as c from flat a join flat b using (sid, k) group by 1, 2, 3),
  shares as (select sid, path, other, exp(c - max(c) over w) / sum(exp(c - m)) over w as share from (select *, max(c) over (partition by sid, path) as m from cosines) window w as (partition by sid, path)),
  mixed as (select s.sid, s.path, k, sum(share * v) as v from shares s join flat f on f.sid = s.sid and f.path = s.other group by 1, 2, 3)"""
TEXTS["wavelet_packet_5d_attentive"] = f"with flat as (select tid as sid, path, k, v from ({packets(_S5)}) where path <> ''), {_COSINES} select sid as tid, path, k, v from mixed union all select sid, '', idx, v from emb", "emb"


# -- complex channels ------------------------------------------------------------------------------------------------------

_CH = "x as (select sid, idx // 2 as n, idx % 2 as ch, v from emb)"
_DFT = "f as materialized (select sid, ch, k, sum(v * cos(2 * pi() * k * n / 32)) as re, -sum(v * sin(2 * pi() * k * n / 32)) as im from x, range(32) t(k) group by all)"
TEXTS["complex_dft"] = f"with {_CH}, {_DFT} select sid, k as n, ch, re, im from f", "emb"
TEXTS["complex_analytic"] = f"""with {_CH}, {_DFT}, g as (select *, case when k in (0, 16) then 1 when k < 16 then 2 else 0 end / 32 as gain from f)
  select sid, n, ch, sum(gain * (re * cos(2 * pi() * k * n / 32) - im * sin(2 * pi() * k * n / 32))) as re, sum(gain * (re * sin(2 * pi() * k * n / 32) + im * cos(2 * pi() * k * n / 32))) as im from g, range(32) t(n) group by sid, n, ch""", "emb"
TEXTS["complex_channel_mix"] = f"with {_CH} select a.sid, a.n, a.ch, sum(b.v * (0.15 / 2 + case when a.ch = b.ch then 0.85 else 0 end)) as re, 0.0 as im from x a join x b using (sid, n) group by a.sid, a.n, a.ch", "emb"
TEXTS["complex_spectral_mask"] = f"with {_CH} select sid, n, ch, v * cos(0.5) as re, v * sin(0.5) as im from x", "emb"
TEXTS["complex_spectral_shift"] = f"with {_CH} select sid, n, ch, v * cos(2 * pi() * 2 * n / 32) as re, v * sin(2 * pi() * 2 * n / 32) as im from x", "emb"
_FULL = "f as materialized (select sid, k, sum(v * cos(2 * pi() * k * idx / 64)) as re, -sum(v * sin(2 * pi() * k * idx / 64)) as im from emb, range(64) t(k) group by all)"
_BACK = "sum(gain * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64)))", "sum(gain * (re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64)))"
TEXTS["hilbert_envelope"] = f"with {_FULL}, g as (select *, case when k in (0, 32) then 1 when k < 32 then 2 else 0 end / 64 as gain from f) select sid, n as idx, sqrt({_BACK[0]} ** 2 + {_BACK[1]} ** 2) as v from g, range(64) t(n) group by sid, n", "emb"
TEXTS["fft_bandpass"] = f"with {_FULL}, g as (select *, case when least(k, 64 - k) between 4 and 16 then 1 else 0 end / 64 as gain from f) select sid, n as idx, {_BACK[0]} as v from g, range(64) t(n) group by sid, n", "emb"


# -- dense graph layers ----------------------------------------------------------------------------------------------------

_GELU = "(0.5 * {0} * (1 + tanh(sqrt(2 / pi()) * ({0} + 0.044715 * ({0}) ** 3))))"
_SIGMOID = "(1 / (1 + exp(-({}))))"


class Layers:
    """Stages over node tables (i, ch, v); each method adds some and names its result."""

    def __init__(self):
        self.names = (f"g{k}" for k in count())
        self.stages = [
            ("x", "select i, 0 as ch, v from nodes union all select i, 1, v * v / 10 from nodes"),
            ("links", "select i, j, w / 100 as w, (w / 1000 + 0.05) / 2 as mean, abs(w / 1000 - 0.05) / 2 as std, greatest(w / 1000, 0.05) as top, least(w / 1000, 0.05) as low from edges"),
            ("looped", "select * from links union all select i, i, 1, 0, 0, 0, 0 from nodes"),
        ]

    def add(self, sql: str) -> str:
        name = next(self.names)
        self.stages.append((name, sql))
        return name

    def end(self, table: str) -> str:
        return materialized(self.stages, f"select i, ch, v from {table}")

    def attention(self, x: str, heads: int = 2, bias: str = "0", where: str = "true", width: int = 2) -> str:
        s = self.add(f"select l.i, l.j, h, (1 + 0.05 * h) * (1 + 0.07 * h) * sum(p.v * q.v) / sqrt({width}) + any_value({bias}) as s from looped l, range({heads}) t(h), {x} p, {x} q where p.i = l.i and q.i = l.j and p.ch = q.ch and {where} group by l.i, l.j, h")
        w = self.add(f"select i, j, h, exp(s - m) / sum(exp(s - m)) over (partition by i, h) as w from (select *, max(s) over (partition by i, h) as m from {s})")
        return self.add(f"select n.i, q.ch, sum(w * (1 + 0.09 * h) * q.v) / {heads} as v from {w} n join {x} q on q.i = n.j group by n.i, q.ch")

    def values(self, x: str, heads: int, alpha: float = 1.0) -> str:
        s = self.add(f"with q as (select i, avg(v) as v from {x} group by i) select l.i, l.j, h, {alpha} * (1 + 0.1 * h) ** 3 * p.v * q.v as s from looped l, range({heads}) t(h), q p, q where p.i = l.i and q.i = l.j")
        w = self.add(f"select i, j, h, exp(s - m) / sum(exp(s - m)) over (partition by i, h) as w from (select *, max(s) over (partition by i, h) as m from {s})")
        return self.add(f"select n.i, q.ch, sum(w * (1 + 0.15 * h) * q.v) / {heads} as v from {w} n join {x} q on q.i = n.j group by n.i, q.ch")

    def norm(self, x: str) -> str:
        return self.add(f"select i, ch, (v - avg(v) over w) / greatest(stddev_pop(v) over w, 1e-5) as v from {x} window w as (partition by i)")

    def each(self, x: str, f: str) -> str:
        return self.add(f"select i, ch, {f.format('v')} as v from {x}")

    def sum(self, *terms: tuple[float, str]) -> str:
        return self.add("select i, ch, sum(v) as v from (" + " union all ".join(f"select i, ch, {c!r} * v as v from {t}" for c, t in terms) + ") group by i, ch")

    def block(self, x: str, y: str, gain: float) -> str:
        """Norm, activation with a gain, and norm of the sum."""
        y = self.norm(y)
        return self.norm(self.sum((gain, self.each(y, _GELU)), (1.0, y)))

    def laplacian(self, x: str) -> str:
        """The normalised Laplacian times x."""
        if not any(n == "lap" for n, _ in self.stages):
            self.stages.append(("deg", "select i, sum(w) as d from links group by i"))
            self.stages.append(("lap", "select i, i as j, 1.0 as w from deg union all select l.i, l.j, -l.w / sqrt(p.d * q.d) from links l join deg p on p.i = l.i join deg q on q.i = l.j"))
        return self.add(f"select lap.i, x.ch, sum(lap.w * x.v) as v from lap join {x} x on x.i = lap.j group by lap.i, x.ch")

    def messages(self, x: str, gate: str) -> str:
        got = self.add(f"select l.i, q.ch, sum((1 + {gate}) * q.v) / count(*) as v from links l join {x} q on q.i = l.j group by l.i, q.ch")
        return self.sum((1.0, x), (1.0, got))

    def sequence(self) -> list[str]:
        last = self.add("select (select max(i) from nodes) - i as i, ch, v from x")
        return ["x", self.sum((0.5, "x")), last]

    def temporal(self, seq: list[str]) -> list[str]:
        """Attention by edges in each step, then near steps by distance."""
        inner = [self.attention(x, 2, "mean + 0.5 * std + 0.25 * top - 0.25 * low") for x in seq]
        out = []
        for t in range(len(seq)):
            near = {u: math.exp(-abs(t - u)) for u in range(len(seq)) if abs(t - u) <= 1}
            out.append(self.sum(*((w / sum(near.values()), inner[u]) for u, w in near.items())))
        return out

    def memory(self, base: list[str], kind: str) -> list[str]:
        """Gated memories over the steps, each cell by itself."""
        wide = "select i, ch, " + ", ".join(f"b{t}.v as b{t}" for t in range(len(base))) + f" from {base[0]} b0 " + " ".join(f"join {b} b{t} using (i, ch)" for t, b in enumerate(base) if t)
        sql = f"select *, 0.0 as h_, 0.0 as c_, 0.0 as s_, 0.0 as u_, 0.0 as m_, 0.0 as k_ from ({wide})"
        was = dict.fromkeys("hcsumk", "")
        was = {k: k + "_" for k in was}
        outs = []

        def let(name: str, t: int, expression: str) -> None:
            nonlocal sql
            sql = f"select *, {expression} as {name}{t} from ({sql})"
            was[name] = f"{name}{t}"

        for t in range(len(base)):
            b, h, c, s, u, m, k = f"b{t}", *(was[x] for x in "hcsumk")
            sig = _SIGMOID.format
            if kind == "ewma":
                let("h", t, f"0.8 * {h} + 0.2 * {b}")
                out = f"0.5 * ({b} + h{t})"
            elif kind == "gru":
                z = sig(f"{b} + 0.8 * {h}")
                let("h", t, f"(1 - {z}) * {h} + {z} * tanh({b} + {sig(f'{b} - 0.8 * {h}')} * {h})")
                out = f"h{t}"
            elif kind == "lstm":
                let("c", t, f"{sig(f'{b} + 0.8 * {h}')} * {c} + {sig(f'{b} - 0.8 * {h}')} * tanh({b} + 0.5 * {h})")
                let("h", t, f"{sig(f'{b} + {h}')} * tanh(c{t})")
                out = f"h{t}"
            elif kind == "hierarchical_lstm":
                let("c", t, f"{sig(f'{b} + {h}')} * {c} + {sig(f'{b} - {h}')} * tanh({b} + 0.5 * {h})")
                let("h", t, f"tanh(c{t})")
                let("u", t, f"{sig(f'h{t} + 0.95 * {s}')} * {u} + {sig(f'h{t} - {s}')} * tanh(h{t} + 0.5 * {s})")
                let("s", t, f"tanh(u{t})")
                out = f"0.5 * (h{t} + s{t})"
            else:
                z = sig(f"{b} + {0.8 if kind == 'hierarchical_gru' else 1.0} * {h}")
                let("h", t, f"(1 - {z}) * {h} + {z} * tanh({b} + {h})")
                if kind == "hierarchical_gru":
                    z = sig(f"h{t} + 0.95 * {s}")
                    let("s", t, f"(1 - {z}) * {s} + {z} * tanh(h{t} + {s})")
                    out = f"0.5 * (h{t} + s{t})"
                else:
                    for name, before, scale in (("m", m, 0.85), ("k", k, 0.95)):
                        z = sig(f"h{t} + {scale} * {before}")
                        let(name, t, f"(1 - {z}) * {before} + {z} * tanh(h{t} + {before})")
                    if kind == "multiscale":
                        out = f"(h{t} + m{t} + k{t}) / 3"
                    else:
                        e = [f"exp(avg(abs({x}{t})) over ())" for x in "hmk"]
                        out = f"(h{t} * {e[0]} + m{t} * {e[1]} + k{t} * {e[2]}) / ({' + '.join(e)})"
            outs.append(out)
        all_ = self.add("select i, ch, " + ", ".join(f"{o} as o{t}" for t, o in enumerate(outs)) + f" from ({sql})")
        return [self.add(f"select i, ch, o{t} as v from {all_}") for t in range(len(base))]


def _graph(name: str):
    def wrap(build):
        g = Layers()
        TEXTS[name] = g.end(build(g)), "edges"

    return wrap


_graph("graph_qkv_attention")(lambda g: g.attention("x"))
_graph("graph_multihead_attention")(lambda g: g.values("x", 2))
_graph("graph_masked_attention")(lambda g: g.attention("x", 2, "mean + std", "l.j >= l.i"))
_graph("graph_edge_attention")(lambda g: g.attention("x", 2, "mean + 0.5 * std + 0.25 * top - 0.25 * low"))


def _message_stack(gate: str):
    def build(g: Layers) -> str:
        x = "x"
        for _ in range(2):
            x = g.sum((1.0, x), (1.0, g.each(g.norm(g.messages(x, gate)), "greatest({}, 0)")))
        return x

    return build


_graph("graph_edge_messages")(_message_stack("l.mean"))
_graph("graph_edge_conditioned")(_message_stack("case when q.ch = 0 then l.w / 10 else 0.05 end"))


@_graph("graph_deep_stack")
def _(g: Layers) -> str:
    x = "x"
    for a, b in ((0.5, 0.2), (0.3, 0.1)):
        y = g.sum((0.5 * a, x), (0.5 * b, g.laplacian(x)), (0.5, g.values(x, 1)))
        x = g.each(g.norm(y), "greatest({}, 0)")
    return x


@_graph("graph_transformer")
def _(g: Layers) -> str:
    x = "x"
    for _ in range(2):
        x = g.block(x, g.sum((1.0, x), (1.0, g.attention(x))), 2.0)
    return x


@_graph("graph_transformer_enhanced")
def _(g: Layers) -> str:
    """Return probabilities of one to four steps are channels 2 to 5; then six channels are mixed into two."""
    power = step = g.add("select i, j, w / sum(w) over (partition by i) as w from links")
    parts = ["select i, ch, v from x"]
    for k in range(4):
        parts.append(f"select n.i, {2 + k}, coalesce(p.w, 0) from nodes n left join {power} p on p.i = n.i and p.j = n.i")
        if k < 3:
            power = g.add(f"select a.i, b.j, sum(a.w * b.w) as w from {power} a join {step} b on a.j = b.i group by a.i, b.j")
    wide = g.add(" union all ".join(parts))
    y = g.attention(wide, 2, width=6)
    mixed = g.add(f"select i, c as ch, sum(v * (0.15 / 6 + case when ch = c then 0.85 else 0 end)) as v from {y}, range(2) t(c) group by i, c")
    return g.block("x", g.sum((1.0, "x"), (1.0, mixed)), 2.0)


_graph("graph_temporal_attention")(lambda g: g.temporal(g.sequence())[-1])
for _kind in ("ewma", "gru", "lstm", "hierarchical_gru", "hierarchical_lstm", "multiscale", "attentive"):
    _graph(f"graph_memory_{_kind}")(lambda g, kind=_kind: g.memory(g.temporal(g.sequence()), kind)[-1])


@_graph("graph_memory_bidirectional")
def _(g: Layers) -> str:
    seq = g.sequence()
    return g.sum((0.5, g.memory(g.temporal(seq), "gru")[-1]), (0.5, g.memory(g.temporal(seq[::-1]), "gru")[0]))


@_graph("graph_temporal_transformer")
def _(g: Layers) -> str:
    seq = g.sequence()
    for _ in range(2):
        seq = [g.block(x, g.sum((1.0, x), (1.0, y)), 2.0) for x, y in zip(seq, g.temporal(seq), strict=True)]
    return seq[-1]


@_graph("graph_memory_stack")
def _(g: Layers) -> str:
    seq = g.sequence()
    for _ in range(2):
        seq = [g.block(x, y, 1.0) for x, y in zip(seq, g.memory(g.temporal(seq), "multiscale"), strict=True)]
    return seq[-1]


@_graph("graph_spectral_filter")
def _(g: Layers) -> str:
    """(1 + L) y = x by damped steps: the error halves each time, as the eigenvalues of 1 + L lie between 1 and 3."""
    y = g.sum((0.5, "x"))
    for _ in range(45):
        y = g.sum((0.5, y), (0.5, "x"), (-0.5, g.laplacian(y)))
    return y


def _heat(g: Layers, f: str) -> str:
    """exp(-s L) x by its series, for both scales; the channels of the second follow."""
    term, sums = "x", {0.5: [(1.0, "x")], 1.0: [(1.0, "x")]}
    for k in range(1, 26):
        term = g.laplacian(term)
        for s in sums:
            sums[s].append(((-s) ** k / math.factorial(k), term))
    both = [g.sum(*sums[s]) for s in (0.5, 1.0)]
    return g.add(" union all ".join(f"select i, ch + {2 * k} as ch, {f.format('v')} as v from {t}" for k, t in enumerate(both)))


_graph("graph_wavelets")(lambda g: _heat(g, "{}"))
_graph("graph_scattering")(lambda g: _heat(g, "abs({})"))


# -- recursions ------------------------------------------------------------------------------------------------------------


def biquad(b: list, a: list) -> str:
    """Of numbers, or of terms in SQL."""
    term = lambda v: f"({v if isinstance(v, str) else repr(v)})::double"
    b0, b1, b2, a1, a2 = (f"({term(v)} / {term(a[0])})" for v in (*b, *a[1:]))
    return f"""with recursive r as (
      select sid, idx, {b0} * v as y0, 0.0::double as y1, v as x1, 0.0::double as x2 from emb where idx = 0
      union all
      select e.sid, e.idx, {b0} * e.v + {b1} * r.x1 + {b2} * r.x2 - {a1} * r.y0 - {a2} * r.y1, r.y0, e.v, r.x1 from r join emb e on e.sid = r.sid and e.idx = r.idx + 1)
      select sid, idx, y0 as v from r"""


def cookbook(kind: str, f: float, q: float) -> str:
    """A second-order section, its coefficients worked out in SQL."""
    c, s = f"cos(2 * pi() * {f})", f"(sin(2 * pi() * {f}) / (2 * {q!r}))"
    b = {
        "lowpass": [f"(1 - {c}) / 2", f"1 - {c}", f"(1 - {c}) / 2"],
        "highpass": [f"(1 + {c}) / 2", f"-1 - {c}", f"(1 + {c}) / 2"],
        "bandpass": [s, "0", f"-{s}"],
        "notch": ["1", f"-2 * {c}", "1"],
        "allpass": [f"1 - {s}", f"-2 * {c}", f"1 + {s}"],
    }[kind]
    return biquad(b, [f"1 + {s}", f"-2 * {c}", f"1 - {s}"])


_Q = {"lowpass": math.sqrt(0.5), "highpass": math.sqrt(0.5), "bandpass": 1.0, "notch": 30.0, "allpass": 0.707}
for _kind, _q in _Q.items():
    TEXTS[f"biquad_{_kind}"] = cookbook(_kind, 0.1, _q), "emb"
_POLE = "0.01 / (1 / (2 * pi() * 10) + 0.01)"  # 10 Hz at 100 samples a second
TEXTS["single_pole_highpass"] = biquad([f"1 - {_POLE}", f"{_POLE} - 1", "0"], ["1", f"{_POLE} - 1", "0"]), "emb"
TEXTS["leaky_integrator"] = biquad(["1", "0", "0"], ["1", "-0.9", "0"]), "emb"
TEXTS["comb_feedforward"] = "select sid, idx, v + 0.5 * coalesce(lag(v, 3) over (partition by sid order by idx), 0) as v from emb", "emb"
TEXTS["comb_feedback"] = "select e.sid, e.idx, sum(p.v * 0.5 ** k) as v from emb e, range(22) t(k), emb p where p.sid = e.sid and p.idx = e.idx - 3 * k group by 1, 2", "emb"
TEXTS["backward_smoother"] = """with recursive r as (select sid, idx, v from emb where idx = 63 union all
  select e.sid, e.idx, 0.3 * e.v + 0.7 * r.v from r join emb e on e.sid = r.sid and e.idx = r.idx - 1) select * from r""", "emb"
_KALMAN = """gains(idx, g, p) as (select 0::bigint, 1.00001::double / 1.01001, 1.00001::double * (1 - 1.00001::double / 1.01001) union all
    select idx + 1, (p + 0.00001) / (p + 0.01001), (p + 0.00001) * (1 - (p + 0.00001) / (p + 0.01001)) from gains where idx < 63),
  xs(sid, idx, x) as (select sid, 0::bigint, v from emb where idx = 0 union all
    select e.sid, e.idx, xs.x + g * (e.v - xs.x) from xs join emb e on e.sid = xs.sid and e.idx = xs.idx + 1 join gains on gains.idx = e.idx)"""
TEXTS["rts_smoother"] = f"""with recursive {_KALMAN}, r(sid, idx, v) as (select sid, idx, x from xs where idx = 63 union all
  select xs.sid, xs.idx, xs.x + p / (p + 0.00001) * (r.v - xs.x) from r join xs on xs.sid = r.sid and xs.idx = r.idx - 1 join gains on gains.idx = xs.idx) select * from r""", "emb"
TEXTS["adaptive_lms"] = """with recursive d as (select a.sid, a.idx, a.v as d, b.v as r from emb a join emb b on b.sid = a.sid + 1 and b.idx = a.idx),
  w(sid, idx, y, e, x0, x1, x2, w0, w1, w2) as (select sid, -1::bigint, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from d where idx = 0 union all
  select sid, idx, y, t - y, r, x0, x1, w0 + 0.1 * (t - y) * r, w1 + 0.1 * (t - y) * x0, w2 + 0.1 * (t - y) * x1
  from (select d.sid, d.idx, d.d as t, d.r, x0, x1, w0, w1, w2, w0 * d.r + w1 * x0 + w2 * x1 as y from w join d on d.sid = w.sid and d.idx = w.idx + 1))
  select sid, idx, y as output, e as error from w where idx >= 0""", "emb"


_LOCAL = """near as (select s.sid, s.idx, any_value(s.v) as v, avg(t.v) as m, var_pop(t.v) as s2 from emb s, range(-2, 3) o(k), emb t
  where t.sid = s.sid and t.idx = case when s.idx + k > 63 then 126 - s.idx - k else abs(s.idx + k) end group by 1, 2)"""
TEXTS["wiener_filter"] = f"with {_LOCAL} select sid, idx, m + greatest(s2 - noise, 0) / greatest(s2, 1e-12) * (v - m) as v from (select *, avg(s2) over (partition by sid) as noise from near)", "emb"
TEXTS["adaptive_wiener"] = f"""with recursive {_LOCAL}, r(sid, idx, noise) as (select sid, -1::bigint, var_pop(v) from emb group by sid union all
  select r.sid, near.idx, 0.9 * noise + 0.1 * s2 from r join near on near.sid = r.sid and near.idx = r.idx + 1)
  select sid, idx, m + greatest(s2 - noise, 0) / greatest(s2, 1e-12) * (v - m) as v from near join r using (sid, idx)""", "emb"


# -- convolutions ----------------------------------------------------------------------------------------------------------


def sinc(taps: int, low: float) -> str:
    """(k, h): a low pass of unit gain under a Hamming window."""
    x, m = f"(k - {(taps - 1) / 2})", taps - 1
    return f"(select k, h / sum(h) over () as h from (select k, case when 2 * k = {m} then 2 * {low}::double else sin(2 * pi() * {low} * {x}) / (pi() * {x}) end * (0.54 - 0.46 * cos(2 * pi() * k / {m})) as h from range({taps}) t(k)))"


def convolved(taps: str, source: str = "samples", every: int = 1) -> str:
    """The middle of the convolution with taps (k, h), as long as the longer side; every so many places of it."""
    return f"""select sid, p // {every} as idx, v from (with h as ({taps}), sized as (select *, count(*) over (partition by sid) as n from {source}), m as (select count(*) as m from h)
      select x.sid, x.idx + k - (least(n, m) - 1) // 2 as p, sum(x.v * h) as v, any_value(greatest(n, m)) as len from sized x, h, m group by 1, 2) where p between 0 and len - 1 and p % {every} = 0"""


def _minus(a: str, b: str) -> str:
    return f"select a.k, a.h - b.h as h from {a} a join {b} b using (k)"


def _whole(taps: int) -> str:
    return f"(select k, case when k = {(taps - 1) // 2} then 1.0 else 0.0 end::double as h from range({taps}) t(k))"


_BAND = _minus(sinc(9, 0.3), sinc(9, 0.1))
TEXTS["fir_highpass"] = convolved(_minus(_whole(10), sinc(10, 0.2))), "samples"
TEXTS["fir_bandpass"] = convolved(_BAND), "samples"
TEXTS["fir_bandstop"] = convolved(_minus(_whole(9), f"({_BAND})")), "samples"
TEXTS["fractional_delay"] = convolved("select k, h / sum(h) over () as h from (select k, sin(pi() * (k - 4.3)) / (pi() * (k - 4.3)) * (0.54 - 0.46 * cos(2 * pi() * k / 8)) as h from range(9) t(k))"), "samples"
TEXTS["differentiator"] = convolved("select * from (values (0, -0.5::double), (1, 0.0), (2, 0.5)) v(k, h)"), "samples"
TEXTS["savitzky_golay"] = convolved("select k, h / 35 as h from (values (0, -3.0::double), (1, 12), (2, 17), (3, 12), (4, -3)) v(k, h)"), "samples"
TEXTS["savitzky_golay_slope"] = convolved("select k, (k - 2) / 10.0::double as h from range(5) t(k)"), "samples"
_LOW = sinc(31, 0.25)
TEXTS["two_band_bank"] = f"select sid, 'low' as band, idx, v from ({convolved(f'select * from {_LOW}', every=2)}) union all select sid, 'high', idx, v from ({convolved(_minus(_whole(31), _LOW), every=2)})", "samples"
_EDGES = (0.125, 0.25, 0.375, 0.499)


def _band(k: int) -> str:
    return convolved(_minus(sinc(31, _EDGES[k]), sinc(31, _EDGES[k - 1])) if k else f"select * from {sinc(31, _EDGES[0])}")


TEXTS["uniform_bank"] = " union all ".join(f"select sid, {k} as band, idx, v from ({convolved(f'select * from {sinc(15, 0.1125)}', f'({_band(k)})', 4)})" for k in range(4)), "samples"


# sum and difference of x[2i] and x[2i - 1] give them back, in places 2i and 2i + 1
TEXTS["haar_rebuild"] = """with p as (select sid, idx, v, coalesce(lag(v) over (partition by sid order by idx), 0) as b from samples)
  select sid, idx + z as idx, case when z = 0 then v else b end as v from p, range(2) t(z) where idx % 2 = 0""", "samples"


# -- detection -------------------------------------------------------------------------------------------------------------

TEXTS["spaced_peaks"] = """with recursive near as (select *, lag(v) over w as a, lead(v) over w as b from samples window w as (partition by sid order by idx)),
  p as (select sid, idx, v, row_number() over (partition by sid order by idx) as m from near where v > a and v >= b and v >= 0),
  s(sid, m, g, idx, v) as (select sid, m, 1, idx, v from p where m = 1 union all
  select p.sid, p.m, s.g + case when p.idx - s.idx >= 4 then 1 else 0 end, case when p.idx - s.idx >= 4 or p.v > s.v then p.idx else s.idx end, case when p.idx - s.idx >= 4 or p.v > s.v then p.v else s.v end
  from s join p on p.sid = s.sid and p.m = s.m + 1) select sid, arg_max(idx, m) as idx, arg_max(v, m) as v from s group by sid, g""", "samples"
