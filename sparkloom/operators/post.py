"""Special tokens around sequences, truncation, padding, masks: native array expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.spec import Spec


@dataclass(frozen=True)
class Template:
    """What stands around sequences: parts are "A", "B" or lists of ids, each with a type id."""

    single: tuple[tuple[str | tuple[int, ...], int], ...]
    pair: tuple[tuple[str | tuple[int, ...], int], ...]

    def overhead(self, pair: bool = False) -> int:
        """Number of ids that the template adds."""
        return sum(len(p) for p, _ in (self.pair if pair else self.single) if p not in ("A", "B"))


_PLAIN = Template((("A", 0),), (("A", 0), ("B", 0)))


def _id(spec: Spec, token: str | None) -> tuple[int, ...]:
    i = spec.ids.get(token) if token is not None else None
    return () if i is None else (i,)


def token_text(value: str | dict | None) -> str | None:
    """A configured token: a string, or an object with its content."""
    return value.get("content") if isinstance(value, dict) else value if isinstance(value, str) else None


def _from_processor(spec: Spec, p: dict) -> Template | None:
    kind = p.get("type")
    if kind == "TemplateProcessing":
        table = p.get("special_tokens") or {}

        def parts(items: list[dict]) -> tuple:
            out = []
            for item in items:
                if "SpecialToken" in item:
                    s = item["SpecialToken"]
                    out.append((tuple((table.get(s["id"]) or {}).get("ids") or ()), s.get("type_id", 0)))
                else:
                    s = item["Sequence"]
                    out.append((s["id"], s.get("type_id", 0)))
            return tuple(out)

        return Template(parts(p.get("single") or []), parts(p.get("pair") or []))
    if kind == "RobertaProcessing":
        named = [(p.get(k) or [d])[0] if isinstance(p.get(k) or [d], list) else d for k, d in (("cls", "<s>"), ("sep", "</s>"))]
        cls, sep = ((_id(spec, n) or _id(spec, d), 0) for n, d in zip(named, ("<s>", "</s>")))
        return Template((cls, ("A", 0), sep), (cls, ("A", 0), sep, sep, ("B", 0), sep))
    if kind == "BertProcessing":
        cls, sep = _id(spec, "[CLS]"), _id(spec, "[SEP]")
        return Template(((cls, 0), ("A", 0), (sep, 0)), ((cls, 0), ("A", 0), (sep, 0), ("B", 1), (sep, 1)))
    return None


def template(spec: Spec) -> Template:
    """The template of a model's post-processor.

    The first processor that adds tokens counts.  If there is one but none adds any, the flags
    add_bos_token and add_eos_token of the configuration apply to single sequences.
    """
    if spec.post is None:
        return _PLAIN
    for p in spec.post.get("processors", []) if spec.post.get("type") == "Sequence" else [spec.post]:
        got = _from_processor(spec, p)
        if got is not None:
            return got
    bos = _id(spec, token_text(spec.config.get("bos_token"))) if spec.config.get("add_bos_token") else ()
    eos = _id(spec, token_text(spec.config.get("eos_token"))) if spec.config.get("add_eos_token") else ()
    return Template(tuple(x for x in ((bos, 0), ("A", 0), (eos, 0)) if x[0]), _PLAIN.pair)


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def around(t: Template, a: Column, b: Column | None = None) -> tuple[Column, Column]:
    """(ids, type ids) of one sequence or a pair in its template."""
    own = {"A": a, "B": b}
    ids, types = [], []
    for part, kind in t.single if b is None else t.pair:
        value = own[part] if isinstance(part, str) else _ints(part)
        ids.append(value)
        types.append(F.array_repeat(F.lit(kind), F.size(value)))
    return ids[0] if len(ids) == 1 else F.concat(*ids), F.concat(*types).cast("array<int>")


def truncate(ids: Column, length: int | Column, side: str = "right") -> Column:
    """At most ``length`` ids; ``side`` is the one that loses."""
    length = F.lit(length) if isinstance(length, int) else length
    if side == "right":
        return F.slice(ids, F.lit(1), F.greatest(length, F.lit(0)))
    size = F.greatest(F.least(F.size(ids), length), F.lit(0))
    return F.slice(ids, F.size(ids) - size + 1, size)


def truncate_pair(a: Column, b: Column, budget: int, side: str = "right") -> tuple[Column, Column]:
    """Both sequences cut to a common budget, the longer one first and the first one on ties."""
    la, lb, most = F.size(a), F.size(b), F.lit(max(budget, 0))
    over = F.greatest(la + lb - most, F.lit(0))
    gap = F.abs(la - lb)
    half = F.floor(most / 2).cast("int")
    ka = F.when(over == 0, la).when(over <= gap, F.when(la >= lb, la - over).otherwise(la)).otherwise(half)
    kb = F.when(over == 0, lb).when(over <= gap, F.when(la >= lb, lb).otherwise(lb - over)).otherwise(most - half)
    return truncate(a, ka, side), truncate(b, kb, side)


def pad(ids: Column, width: Column | int, value: int, side: str = "right") -> Column:
    """Ids filled up to a width; longer rows stay."""
    width = F.lit(width) if isinstance(width, int) else width
    fill = F.array_repeat(F.lit(value).cast("int"), F.greatest(width - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def mask(ids: Column, width: Column | int, side: str = "right") -> Column:
    """1 for every id, 0 for the filling."""
    return pad(F.array_repeat(F.lit(1), F.size(ids)), width, 0, side)


def longest(df: DataFrame, ids: str, batch: str | None = None) -> tuple[DataFrame, Column]:
    """The frame with the longest row's size: of the rows with the same ``batch``, or of all.

    An aggregate with partial maxima, then a scalar subquery or a join by batch, so that a batch that
    holds most rows is never gathered in one task.
    """
    most = F.coalesce(F.max(F.size(ids)), F.lit(0))
    if batch is None:
        return df, df.agg(most.alias("_width")).scalar()
    widths = df.groupBy(F.col(batch).alias("_batch")).agg(most.alias("_width"))
    return df.join(widths, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch"), F.col("_width")
