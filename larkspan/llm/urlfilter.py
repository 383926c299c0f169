"""URL filters: a trie over reversed host labels and path segments, broadcast, longest match wins.

A rule is (host, path prefix, verdict).  It fits its host and all subdomains when the url's path starts with the
rule's path.  Of the rules that fit, the one with the longest host wins, then the one with the longest path; of two
equal rules ``block`` beats ``allow``.

Cases: a null url, or one without ``://``, has host and path empty and fits no rule; a url no rule fits gets the
default verdict and a null rule; equal urls get equal rows; an empty rule list gives every url the default.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules beyond this many are joined as a table instead of being broadcast as a trie.
TRIE_LIMIT = 200_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/?#``, A-Z lowered; then up to ``?#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def build_trie(rules) -> dict:
    """Host labels from the last to the first; at a host's node, path segments; a last piece without its slash is a tail."""
    root: dict = {"next": {}, "paths": None}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        seg = node["paths"] = node["paths"] or {"next": {}, "tails": {}}
        *whole, tail = path.split("/")
        for s in whole:
            seg = seg["next"].setdefault(s, {"next": {}, "tails": {}})
        if seg["tails"].get(tail, (None, "allow"))[1] != "block":
            seg["tails"][tail] = (f"{host}{path}", verdict)
    return root


def longest(trie: dict, host: str, path: str):
    """The winning (rule, verdict), or None: deepest host that has a fitting path, then the deepest path there."""
    chain, node = [trie["paths"]], trie
    for label in reversed(host.split(".")) if host else ():
        node = node["next"].get(label)
        if node is None:
            break
        chain.append(node["paths"])
    segments = path.split("/")
    for paths in reversed(chain):
        if paths is None:
            continue
        best, seg = None, paths
        for i in range(len(segments)):
            rest = segments[i]
            fits = [t for t in seg["tails"] if rest.startswith(t)]
            if fits:
                best = seg["tails"][max(fits, key=len)]
            seg = seg["next"].get(rest) if i + 1 < len(segments) else None
            if seg is None:
                break
        if best is not None:
            return best
    return None


def _trie_match(parts: DataFrame, rules, default: str) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def match(host, path):
        import pandas as pd

        trie, seen, out = shared.value, {}, []
        for key in zip(host, path):
            if key not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[key] = longest(trie, *key) or (None, default)
            out.append(seen[key])
        return pd.DataFrame(out, columns=["rule", "verdict"])

    return parts.withColumn("_v", match("_host", "_path")).select("*", "_v.rule", "_v.verdict").drop("_v")


def _table_match(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rule lists of any size: hosts meet rules on every host suffix, once per distinct url."""
    urls = parts.select("_host", "_path").distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    suffixes = F.when(F.col("_host") == "", F.array(F.lit(""))).otherwise(F.concat(suffixes, F.array(F.lit(""))))
    r = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv"))
    depth = F.when(F.col("_suffix") == "", 0).otherwise(F.size(F.split("_suffix", r"\.")))
    won = (
        urls.select("*", F.explode(suffixes).alias("_suffix"))
        .join(r, "_suffix")
        .where(F.col("_path").startswith(F.col("_rp")))
        .groupBy("_host", "_path")
        .agg(F.max(F.struct(depth, F.length("_rp"), F.col("_rv"), F.concat("_suffix", "_rp").alias("rule"))).alias("_w"))
        .select("_host", "_path", F.col("_w.rule").alias("rule"), F.col("_w._rv").alias("verdict"))
    )
    return parts.join(won, ["_host", "_path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def url_filter(pages: DataFrame, rules, url_col: str = "url", default: str = "allow", limit: int = TRIE_LIMIT) -> DataFrame:
    """``pages`` with host, path, rule and verdict.  ``rules``: a list of (host, path, verdict) or such a DataFrame."""
    host, path = url_parts(F.col(url_col))
    own = ("host", "path", "rule", "verdict")
    parts = pages.select(*[c for c in pages.columns if c not in own], host.alias("_host"), path.alias("_path"))
    if isinstance(rules, DataFrame):
        held = rules.select("host", "path", "verdict").limit(limit + 1).collect()
        out = _trie_match(parts, [tuple(r) for r in held], default) if len(held) <= limit else _table_match(parts, rules, default)
    elif len(rules) <= limit:
        out = _trie_match(parts, rules, default)
    else:
        out = _table_match(parts, parts.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), default)
    return out.withColumnsRenamed({"_host": "host", "_path": "path"})
