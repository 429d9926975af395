"""The query surface for one learner and one graph: eight calls that return plain dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmill.functions import scalar as S
from conceptmill.operators import graph as G
from conceptmill.operators import learner as L
from conceptmill.operators import paths as P
from conceptmill.operators import retrieval as R
from conceptmill.operators.embedders import HashEmbedder

from . import index as X


@dataclass
class Session:
    """A graph, the learners' states and the day that decay counts to."""

    graph: G.Graph
    states: DataFrame
    as_of: str
    user_id: str = "me"
    embedder: object = None
    _index: X.Index | None = field(default=None, repr=False)

    @property
    def one(self) -> DataFrame:
        return L.mastery(self.states.filter(F.col("user_id") == self.user_id), self.as_of)

    def _resolved(self, query: str) -> str | None:
        row = G.resolve(self.graph, query).first()
        return row["id"] if row else None

    def get_learner_profile(self, domain: str = "") -> dict:
        nodes = self.graph.nodes.filter(F.col("domain") == domain) if domain else self.graph.nodes
        m = L.with_mastery(nodes, self.one).withColumn("band", S.band(F.col("mastery")))
        bands = {r["band"]: r["ids"] for r in m.groupBy("band").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}
        total = m.agg(F.count("*").alias("n"), F.count_if(F.col("mastery") > 0).alias("touched"), F.round(F.avg(F.when(F.col("mastery") > 0, F.col("mastery"))), 3).alias("avg")).first()
        return {"total": total["n"], "touched": total["touched"], "avg_mastery": total["avg"] or 0.0, "bands": {b: {"ids": bands[b], "color": S.BAND_COLORS[b]} for b in S.BAND_COLORS if b in bands}}

    def check_readiness(self, target: str) -> dict:
        found = self._resolved(target)
        if found is None:
            return {"error": f"no concept matches {target!r}"}
        goal = self.graph.nodes.filter(F.col("id") == found)
        up = G.ancestors(self.graph.prerequisites, goal.select("id")).select(F.col("ancestor").alias("id"))
        rows = L.with_mastery(self.graph.nodes.join(up, "id", "left_semi"), self.one).orderBy(F.desc("difficulty"), "id").collect()
        pick = lambda low, high: [r["id"] for r in rows if low <= r["mastery"] < high]
        gaps, reviews = pick(-1, S.GAP_BELOW), pick(S.GAP_BELOW, S.PREREQUISITE_MET)
        return {"target": found, "verdict": "not_ready" if gaps else "needs_review" if reviews else "ready", "gaps": gaps, "reviews": reviews, "ok": pick(S.PREREQUISITE_MET, 2)}

    def get_learning_path(self, target: str, include_known: bool = True) -> dict:
        found = self._resolved(target)
        if found is None:
            return {"error": f"no concept matches {target!r}"}
        try:
            steps = P.learning_path(self.graph, found, self.one, include_known)
        except ValueError as e:
            return {"error": str(e)}
        named = steps.join(self.graph.nodes.select("id", "name", "domain", "difficulty", S.shortened(F.col("desc")).alias("desc")), "id")
        rows = [r.asDict() for r in named.orderBy("place").collect()]
        return {"target": found, "total": len(rows), "gap_count": sum(r["status"] == "gap" for r in rows), "steps": rows}

    def recommend_next(self, limit: int = 5) -> list[dict]:
        return [r.asDict() for r in P.recommend_next(self.graph, self.one, max(1, min(limit, 20))).collect()]

    def query_node(self, keyword: str) -> dict:
        found = self._resolved(keyword)
        if found is None:
            return {"error": f"no concept matches {keyword!r}"}
        nodes = L.with_mastery(self.graph.nodes, self.one)
        mine = F.col("id") == found
        pre = self.graph.prerequisites
        before = pre.filter(F.col("target") == found).select(F.col("source").alias("id")).distinct()
        after = G.dependents(self.graph).filter(mine).select(F.col("dependent").alias("id"))
        alike = G.confusable(self.graph).filter(mine).select(F.col("other").alias("id"))
        listed = lambda ids, cols: [r.asDict() for r in nodes.join(ids, "id", "left_semi").orderBy("id").select(*cols).collect()]
        others = [r["id"] for r in G.find(self.graph, keyword).select("id").limit(6).collect() if r["id"] != found][:5]
        return {"node": nodes.filter(mine).drop("ord").first().asDict(recursive=True), "prerequisites": listed(before, ["id", "name", "mastery"]), "unlocks": listed(after, ["id", "name"]), "confusable": listed(alike, ["id", "name"]), "candidates": others}

    def list_domains(self) -> list[dict]:
        return [r.asDict() for r in L.domain_overview(self.graph.nodes, self.one).orderBy(F.desc("n"), "first_ord").drop("first_ord").collect()]

    def update_mastery(self, concept: str, evidence_type: str = "conversation", desc: str = "", weight: float = 0.3, revoke_last: bool = False) -> dict:
        """Append or take back evidence; the session's states change, persisting is the caller's choice."""
        found = self._resolved(concept)
        if found is None:
            return {"error": f"no concept matches {concept!r}"}
        if evidence_type not in S.EVIDENCE_TYPES:
            return {"error": f"unknown evidence type {evidence_type!r}"}
        mine = (F.col("user_id") == self.user_id) & (F.col("concept_id") == found)
        if revoke_last:
            row = self.states.filter(mine).first()
            standing = [i for i, e in enumerate(row["evidence"] or []) if not e["revoked"]] if row else []
            if not standing:
                return {"error": "nothing to revoke"}
            struck = F.transform("evidence", lambda e, i: e.withField("revoked", e["revoked"] | (i == standing[-1])))
            value = S.evidence_mastery(struck, F.col("last_touched"), F.to_date(F.lit(self.as_of)))
            self.states = self.states.withColumns({"mastery": F.when(mine, value).otherwise(F.col("mastery")), "evidence": F.when(mine, struck).otherwise(F.col("evidence"))})
        else:
            self.states = L.mark(self.states, self.user_id, found, self.as_of, evidence=[(evidence_type, desc, max(0.0, min(1.0, weight)))], source=evidence_type)
        self.states = G.cut(self.states)
        return {"id": found, "mastery": self.one.filter(F.col("concept_id") == found).first()["mastery"]}

    def search_knowledge(self, query: str, mode: str = "local", max_context: int = 12, communities: DataFrame | None = None) -> dict:
        """Any mode but "global" is local; the index is built once and again only when graph, mastery or embedder changed."""
        embedder = self.embedder or HashEmbedder()
        if self._index is None or self._index.signature != X.signature(self.graph, self.one, embedder):
            made = X.build(self.graph, self.one, embedder)
            self._index = X.Index(G.cut(made.nodes), G.cut(made.communities), made.signature)
        if mode == "global":
            told = self._index.communities if communities is None else communities
            vectors = told if "vector" in told.columns else embedder.embed(told, "id", "summary").join(told, "id")
            hits = R.global_search(vectors.select("id", "ord", "vector"), told.drop("vector"), query, embedder=embedder)
            return {"mode": "global", "nodes": [r.asDict() for r in hits.orderBy(F.desc("sim"), "place").collect()]}
        context = G.cut(R.search(self.graph, self._index.nodes, query, self.one, embedder=embedder, names=self._index.names, max_context=max(3, min(max_context, 25))))
        rows = [r.asDict() for r in context.orderBy("place").collect()]
        return {"mode": "local", "nodes": rows, "context_text": R.rendered(context).first()["context_text"] if rows else ""}
