"""The queries of this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordweave.llm import chat, factors, leaks, lines, packing, pii, ppm, quality, ranked, simhash, suffixes, trie, winnow
from recordweave.plans.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash")
def op1_simhash(t: Tables) -> DataFrame:
    return simhash.near_duplicates(t.documents)


@query("op2_line_chunks", lines.SQL)
def op2_line_chunks(t: Tables) -> DataFrame:
    return lines.line_report(t.documents)


@query("op9_template_leaks")
def op9_template_leaks(t: Tables) -> DataFrame:
    return leaks.leak_report(t.documents, t.benchmark)


@query("op5_best_fit_packing")
def op5_best_fit_packing(t: Tables) -> DataFrame:
    return packing.pack(t.documents)


@query("op7_reply_trees", chat.SQL)
def op7_reply_trees(t: Tables) -> DataFrame:
    probe = t.spark.createDataFrame(
        [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = t.conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    # a plain conversation is one tree with one path
    return chat.read_back(chat.format_paths(chat.paths(chat.linear_nodes(rows)))).drop("root_id", "branch")


@query("op8_line_crf")
def op8_line_crf(t: Tables) -> DataFrame:
    return quality.quality(t.documents, t.labels)


@query("op3_winnowing")
def op3_winnowing(t: Tables) -> DataFrame:
    return winnow.edited_report(t.documents)


@query("op6_partial_matching")
def op6_partial_matching(t: Tables) -> DataFrame:
    return ppm.score(t.documents)


@query("op4_char_tagger")
def op4_char_tagger(t: Tables) -> DataFrame:
    return pii.find_all(t.documents)


@query("op10_suffix_array")
def op10_suffix_array(t: Tables) -> DataFrame:
    return suffixes.removals(t.documents).drop("kept")


@query("op12_lempel_ziv", factors.SQL)
def op12_lempel_ziv(t: Tables) -> DataFrame:
    return factors.removals(t.documents).drop("kept")


@query("op13_length_strata", ranked.SQL)
def op13_length_strata(t: Tables) -> DataFrame:
    return ranked.search(ranked.build(t.documents), t.benchmark)


@query("op11_depth_bands", trie.SQL)
def op11_depth_bands(t: Tables) -> DataFrame:
    return trie.prefix_trie(t.conversations)
