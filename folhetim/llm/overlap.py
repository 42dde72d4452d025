"""The same or nearly the same records in the training and the evaluation splits (problem 6).

Method: exact prefix-filter bipartite join on rare shingles, single words here as TESTDATA.md defines
copies by words. With its words in one order, rare ones first, a bag of n words that shares 0.8 n words
with another shares one of its first n - ceil(0.8 n) + 1 with the other's first ones. The prefixes of
evaluation records, and of unassigned ones that may connect them to training, are the index; training
records probe it, and so do the index's own, with length and position filters; overlaps are verified
exactly. Two training records are never paired, and every other link is found. Groups are the
components of the links.

The order is that of all words' counts, kept in a table of fixed size by hash (SLOTS); words that share
a slot count as one. Any order gives all links; this one keeps the buckets small. Buckets of one word that
many records share are cut by a second word: linked bags share two among one word more of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhetim.llm.nearcopies import PAIRED, Nodes, bucket_links, first_words, word_counts
from folhetim.llm.spread import Workspace, small

EVALUATION, TRAINING = ("validacao", "teste"), "treino"
#: The length and the position filter, for two members of a word's bucket.
FILTERS = "least(x.n, y.n) * 1000 >= greatest(x.n, y.n) * {share} and 1 + least(x.n - x.posicao, y.n - y.posicao) >= ceil(greatest(x.n, y.n) * {share} / 1000)"


def cross_split(records: DataFrame, assigned: DataFrame, share: float = 0.8, paired: int = PAIRED) -> DataFrame:
    """``chave, particao``: the assignments to an evaluation split of a record that is in training too, itself or as a copy.

    ``records``: ``wordsets.RECORD``; ``assigned``: ``chave, particao``, where repeated and conflicting
    rows all count, null keys and null or other splits don't. Records without a bag (no or a short text)
    are found by their key alone. A node that training has, itself or through an equal text, is not of
    the index, as its other copies are reached from it.
    """
    space = Workspace(records.sparkSession)
    known = Nodes(records, space)
    valid = space.write(assigned.where(F.col("chave").isNotNull() & F.col("particao").isin(*EVALUATION, TRAINING)).distinct())
    training = valid.where(F.col("particao") == TRAINING).select("chave")
    trained = space.write(known.member().join(training, "chave", "left_semi").select("no").distinct().withColumn("treino", F.lit(True)))
    told = known.nodes.select("no", "palavras").join(small(trained), "no", "left").select("no", "palavras", F.col("treino").isNull().alias("indice"))
    counts = word_counts(known.nodes)
    prefixes = space.write(first_words(told, counts, share, more=1).withColumn("faixa", F.col("palavra")))
    thousandths = round(share * 1000)
    members = prefixes.where(f"posicao <= n - ceil(n * {thousandths} / 1000) + 1").drop("palavra")

    def by_second_word(large: DataFrame) -> DataFrame:
        second = prefixes.select("no", F.col("palavra").alias("outra"))
        return large.join(second, "no").where("outra <> faixa").withColumn("faixa", F.xxhash64("faixa", "outra")).drop("outra")

    links = bucket_links(members, known.nodes, space, share, paired, FILTERS.format(share=thousandths), by_second_word)
    of_class = known.classes(links, space)
    with_training = of_class.join(training, "chave", "left_semi").select("c").distinct()
    copies = of_class.join(with_training, "c", "left_semi").select("chave")
    return valid.where(F.col("particao") != TRAINING).join(copies.union(training).distinct(), "chave", "left_semi")
