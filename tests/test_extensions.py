"""O11 user-defined analysis and O12 user-defined clusterer."""

from pyspark.sql import functions as F

from strata.functions.similarity import distance
from strata.operators.components import connected_components
from strata.operators.contract import contract_vectors_by_moves
from strata.plans.analyses import Analysis
from strata.plans.pipeline import decompose
from strata.session import cut
from strata.sources.derive import atoms_from_list


class SameLabel(Analysis):
    """Similarity 1 between clusters sharing any label, 0 otherwise."""

    def __init__(self, labels):
        super().__init__()
        self.labels = labels  # (idx, label)

    def bind(self, atoms):
        self._support = cut(self.labels.select("idx").distinct().join(atoms.select("idx"), "idx", "left_semi"))

    def _seed_state(self, assign):
        v = self.labels.join(assign, "idx").select(F.col("cid").alias("node"), F.col("label").alias("term"),
                                                   F.lit(1.0).alias("x"))
        self.vec = cut(v.groupBy("node", "term").agg(F.sum("x").alias("x")))
        self.cnt = cut(assign.join(self.support, "idx", "left_semi").groupBy(F.col("cid").alias("node"))
                       .agg(F.count(F.lit(1)).alias("n")))

    def _move_state(self, moves):
        v, c = contract_vectors_by_moves(self.vec, self.cnt, moves)
        self.vec, self.cnt = cut(v), cut(c)

    def _compute_similarity(self, floor):
        a = self.vec.select(F.col("node").alias("i"), "term")
        b = self.vec.select(F.col("node").alias("j"), "term")
        return a.join(b, "term").select("i", "j").distinct().withColumn("sim", F.lit(1.0))


def single_linkage(sim, nodes, eps, min_samples):
    """A user clusterer: connected components of pairs within eps (no density)."""
    e = sim.where(distance(F.col("sim")) <= eps).where(F.col("i") < F.col("j"))
    return connected_components(e, "i", "j")


def test_user_analysis_and_clusterer(spark):
    atoms = atoms_from_list(spark, [str(i) for i in range(6)])
    labels = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b"), (3, "c"), (4, "c"), (5, "d")],
                                   "idx long, label string")
    res = decompose(spark, atoms, {}, pipeline=["labels"], analyses={"labels": SameLabel(labels)},
                    params={"labels": {"epsilon": 0.2}, "clustering": {"strategy": "sequential"}},
                    clusterer=single_linkage)
    parts = {}
    for r in res.final.collect():
        parts.setdefault(r.cid, []).append(r.idx)
    assert sorted(map(sorted, parts.values())) == [[0, 1], [2, 3, 4], [5]]
    assert res.run.merging_steps == 1
