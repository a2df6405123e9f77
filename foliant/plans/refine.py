"""Outline refinement in rounds: a model proposes an outline and where its nodes come from, the proposal is checked against
the current outline, shown as a difference, and taken, left or taken back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import model_calls, workspace
from foliant.session import checkpoint

ANSWER = "struct<outline_refined: struct<nodes: array<struct<node_id: string, title: string, level: int>>>, node_mappings: array<struct<refined_node_id: string, source_node_ids: array<string>, char_start: bigint, char_end: bigint>>, change_summary: string>"


def _shape(found: dict) -> str | None:
    nodes = found.get("outline_refined", {}).get("nodes") if isinstance(found.get("outline_refined"), dict) else None
    return None if isinstance(nodes, list) and isinstance(found.get("node_mappings"), list) else "outline_refined or node_mappings is missing"


def _prompts(original: DataFrame, current: DataFrame, instruction: str, key: str) -> DataFrame:
    listed = lambda df, name: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("node_id", "title", "level", "char_start", "char_end").alias("node")))), lambda x: x["node"]).alias(name))
    both = listed(original, "original_outline").join(listed(current, "current_outline"), key)
    return both.select(key, F.to_json(F.struct(F.lit(instruction).alias("instruction"), "original_outline", "current_outline")).alias("prompt"))


def refine_round(original: DataFrame, current: DataFrame, client: Callable, instruction: str, key: str = "doc_id", system: str = "", retries: int = 2, strict: bool = True) -> dict[str, DataFrame]:
    """One round: ``nodes`` and ``mapping`` of the documents whose proposal holds, and a ``preview`` (key, change_summary, removed, added, problems, passed) of all.

    A proposal holds if its mapping names only nodes of the original outline and its ranges meet without overlap or, if strict, gap;
    documents whose doesn't are asked again, ``retries`` times at most. Outlines: key, ord, node_id, title, level, char_start, char_end.
    """
    asked, nodes, mapping, previews = _prompts(original, current, instruction, key), None, None, None
    before = current.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("before"))
    for attempt in range(retries + 1):
        got = checkpoint(model_calls.call(asked, "prompt", client, key, system, _shape, 0).select(key, "error", F.from_json("answer", ANSWER).alias("a")))
        proposed = got.select(key, F.posexplode("a.outline_refined.nodes").alias("ord", "n")).select(key, "ord", "n.*")
        mapped = got.select(key, F.posexplode("a.node_mappings").alias("ord", "m")).select(key, "ord", "m.*")
        unknown = workspace.unknown_sources(mapped, original, key).select(key, F.concat(F.lit("unknown source: "), "source_node_id").alias("p"))
        ids = proposed.select(F.col(key).alias("k2"), F.col("node_id").alias("id2"))
        orphans = mapped.join(ids, (F.col(key) == F.col("k2")) & (F.col("refined_node_id") == F.col("id2")), "left_anti").select(key, F.concat(F.lit("unknown node: "), "refined_node_id").alias("p"))
        ranges = workspace.mapping_problems(mapped.where("char_start is not null and char_end is not null"), key, strict).where("problem <> 'gap_warning'").select(key, F.concat("problem", F.lit(": "), "refined_node_id").alias("p"))
        failed = got.where("a is null").select(key, F.coalesce("error", F.lit("no answer")).alias("p"))
        problems = unknown.unionByName(orphans).unionByName(ranges).unionByName(failed).groupBy(key).agg(F.array_sort(F.collect_set("p")).alias("problems"))
        after = proposed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("after"))
        preview = got.select(key, F.coalesce(F.nullif(F.trim("a.change_summary"), F.lit("")), F.lit("no summary")).alias("change_summary")).join(before, key).join(after, key, "left").join(problems, key, "left")
        diff = workspace.title_diff(F.col("before"), F.coalesce("after", F.array().cast("array<string>")))
        preview = preview.select(key, "change_summary", diff["removed"].alias("removed"), diff["added"].alias("added"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))
        preview = checkpoint(preview.withColumn("passed", F.size("problems") == 0))
        passed, last = preview.where("passed").select(key), attempt == retries
        good = lambda df, passed=passed: df.join(passed, key, "left_semi")
        shown = preview if last else preview.where("passed")
        nodes, mapping, previews = (good(proposed), good(mapped), shown) if nodes is None else (nodes.unionByName(good(proposed)), mapping.unionByName(good(mapped)), previews.unionByName(shown))
        asked = checkpoint(asked.join(passed, key, "left_anti"))
        if not last and asked.isEmpty():
            break
    return {"nodes": nodes, "mapping": mapping, "preview": previews}


def accept(current: DataFrame, proposal: dict[str, DataFrame], chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """The outlines after a round: the proposal's for the documents in ``chosen`` (key) that passed, else as they were.

    Nodes take the range of their mapping. Leaving a document out of ``chosen`` discards its proposal; the original outline is the reset.
    """
    taken = proposal["preview"].where("passed").select(key).join(chosen.select(key), key, "left_semi")
    at = proposal["mapping"].groupBy(key, F.col("refined_node_id").alias("node_id")).agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    new = proposal["nodes"].join(taken, key, "left_semi").join(at, [key, "node_id"], "left")
    return current.join(taken, key, "left_anti").select(key, "ord", "node_id", "title", "level", "char_start", "char_end").unionByName(new.select(key, "ord", "node_id", "title", "level", "char_start", "char_end"))
