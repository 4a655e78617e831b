"""The property graph as DataFrames, and the same graph derived from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.sources.staging import dealt

#: Node labels with their key property, and edge types.
LABELS = {"Person": "person_id", "Role": "role_id", "Company": "name", "Project": "project_id", "Education": "education_id", "Achievement": "achievement_id", "Skill": "name"}
EDGE_TYPES = ["HAD_ROLE", "AT", "BUILT", "DURING", "USED", "DEMONSTRATES", "ACHIEVED", "STUDIED_AT", "LEARNED", "PART_OF"]
#: Types of which there are about as many as lines.
MANY = ["USED", "DEMONSTRATES", "ACHIEVED"]


@dataclass
class Graph:
    """One DataFrame per label and one of edges ``(type, src_label, src_key, dst_label, dst_key)``, each at most once."""

    person: DataFrame
    role: DataFrame
    company: DataFrame
    project: DataFrame
    education: DataFrame
    achievement: DataFrame
    skill: DataFrame
    edges: DataFrame

    def edge(self, kind: str, src: str | None = None, dst: str | None = None) -> DataFrame:
        """``src_key, dst_key`` of one type of edge."""
        e = self.edges.where(F.col("type") == kind)
        e = e.where(F.col("src_label") == src) if src else e
        e = e.where(F.col("dst_label") == dst) if dst else e
        return e.select("src_key", "dst_key")

    def nodes(self) -> DataFrame:
        """``label, key, props`` over all labels; missing properties are left out of the map."""
        found = None
        for label, key in LABELS.items():
            df = getattr(self, label.lower())
            pairs = [F.struct(F.lit(c).alias("key"), (F.array_join(c, "|") if t.startswith("array") else F.col(c).cast("string")).alias("value")) for c, t in df.dtypes]
            props = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))
            one = df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), props.alias("props"))
            found = one if found is None else found.unionByName(one)
        return found


def _edge(df: DataFrame, kind: str, src: str, src_key, dst: str, dst_key) -> DataFrame:
    """Edges from rows that are distinct in what makes their keys: these are numbers, much shorter than the texts of an edge."""
    return df.select(F.lit(kind).alias("type"), F.lit(src).alias("src_label"), src_key.cast("string").alias("src_key"), F.lit(dst).alias("dst_label"), dst_key.cast("string").alias("dst_key"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph views over the star-schema tables: customers are people, suppliers roles, nations companies, orders
    projects, regions educations, returned lines achievements, and part names the vocabulary."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    none = F.lit(None).cast("string")
    part, orders, customer, supplier, nation, region = map(t, ("part", "orders", "customer", "supplier", "nation", "region"))
    line = t("lineitem")
    noun = F.element_at(F.split("p_name", " "), -1)
    category = F.when(noun.isin("ring", "widget"), "technical").when(noun.isin("bolt", "gear"), "tool").when(noun == "rod", "language").otherwise("capability")
    alias = F.when(F.col("p_size") <= 2, F.concat_ws(" ", F.lower("p_brand"), F.lower("p_type")))
    skill = part.groupBy(F.col("p_name").alias("name")).agg(F.sort_array(F.collect_set(alias)).alias("aliases"), F.first(category).alias("category"))
    skill = skill.select("name", F.upper("name").alias("display_name"), F.when(F.size("aliases") > 0, F.col("aliases")).alias("aliases"), "category")

    person = customer.select(F.col("c_custkey").cast("string").alias("person_id"), F.col("c_name").alias("name"))
    start = F.when(F.col("s_suppkey") % 3 == 0, "2019").when(F.col("s_suppkey") % 3 == 1, "2019-03")
    role = supplier.select(F.col("s_suppkey").cast("string").alias("role_id"), F.col("s_name").alias("title"), none.alias("description"), start.alias("start_date"), none.alias("end_date"), none.alias("location"),
        F.when(F.col("s_suppkey") % 2 == 0, "remote").alias("work_mode"), F.when(F.col("s_suppkey") % 7 == 0, "volunteer").alias("employment_type"))
    company = nation.select(F.col("n_name").alias("name"))
    project = orders.select(F.col("o_orderkey").cast("string").alias("project_id"), F.concat(F.lit("Project "), F.col("o_orderkey")).alias("name"),
        F.when(F.col("o_orderpriority") == "5-LOW", "volunteer").alias("type"), none.alias("domain"), F.col("o_orderpriority").alias("context"), none.alias("description"), none.alias("role"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), none.alias("end_date"), none.alias("location"), none.alias("work_mode"))
    education = region.select(F.col("r_regionkey").cast("string").alias("education_id"), F.col("r_name").alias("institution"), F.lit("Studies").alias("program"), F.lit("completed").alias("status"),
        F.concat(F.lit("Studies in "), F.col("r_name")).alias("description"), F.lit("2015").alias("start_date"), none.alias("end_date"))
    amount = F.col("l_quantity").cast("int")
    # a description is its three numbers in words, and a metric one number; equal rows are found by these, in a task for each 250,000
    # lines, so that neither the length of texts nor the number of lines decides on a task's memory
    lines = line.count()
    whole = amount.isNotNull() & F.col("l_linenumber").isNotNull() & F.col("l_orderkey").isNotNull()
    numbers = {"n_of": F.when(whole, F.col("l_linenumber")), "n_order": F.when(whole, F.col("l_orderkey")), "n_amount": F.when(whole, amount), "n_metric": F.when(F.col("l_linenumber") % 2 == 0, amount)}
    text = F.concat(F.lit("Delivered "), F.col("n_amount"), F.when(F.col("n_of") % 2 == 0, " items").otherwise(" lots"), F.lit(" in line "), F.col("n_of"), F.lit(" of order "), F.col("n_order"))
    returned = line.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", *[c.alias(k) for k, c in numbers.items()])
    told = ["n_of", "n_order", "n_amount"]

    def once(df: DataFrame, *names: str) -> DataFrame:
        return dealt(df.select(*names), lines, *names).distinct()

    achievement = once(returned, *told, "n_metric").select(text.alias("achievement_id"), text.alias("description"), F.concat("n_metric", F.lit(" items")).alias("metric"))

    owner = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    names = part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    during = orders.where("o_orderstatus = 'F'").join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.min("l_suppkey").alias("role"))
    had = during.select("o_custkey", "role").unionByName(
        customer.join(supplier, F.col("c_custkey") % 10 == F.col("s_suppkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("s_suppkey").alias("role"))
    )
    used = line.where("l_returnflag = 'N'").join(names, "l_partkey")
    learned = line.where("l_returnflag = 'A'").join(names, "l_partkey").join(owner.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).where("length(p_name) % 5 = n_regionkey")
    key = F.col
    at = supplier.where("s_suppkey % 5 <> 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    studied = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        _edge(had.distinct(), "HAD_ROLE", "Person", key("o_custkey"), "Role", key("role")),
        _edge(at.select("s_suppkey", "n_name").distinct(), "AT", "Role", key("s_suppkey"), "Company", key("n_name")),
        _edge(orders.select("o_custkey", "o_orderkey").distinct(), "BUILT", "Person", key("o_custkey"), "Project", key("o_orderkey")),
        _edge(during.select("o_orderkey", "role").distinct(), "DURING", "Project", key("o_orderkey"), "Role", key("role")),
        _edge(once(used, "l_orderkey", "p_name"), "USED", "Project", key("l_orderkey"), "Skill", key("p_name")),
        _edge(once(returned.join(names, "l_partkey"), *told, "p_name"), "DEMONSTRATES", "Achievement", text, "Skill", key("p_name")),
        _edge(once(returned, "l_orderkey", *told), "ACHIEVED", "Project", key("l_orderkey"), "Achievement", text),
        _edge(studied.select("c_custkey", "n_regionkey").distinct(), "STUDIED_AT", "Person", key("c_custkey"), "Education", key("n_regionkey")),
        _edge(learned.select("n_regionkey", "p_name").distinct(), "LEARNED", "Education", key("n_regionkey"), "Skill", key("p_name")),
        _edge(owner.where("o_orderstatus = 'P'").select("o_orderkey", "n_regionkey").distinct(), "PART_OF", "Project", key("o_orderkey"), "Education", key("n_regionkey")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return Graph(person, role, company, project, education, achievement, skill, edges)


RELATED = "array<struct<skill_query:string,reason:string,source:string>>"


def star_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, seq, raw, skill_query, importance, category, related``: one requirement per part, 25 parts to a job."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    both = F.concat_ws(" ", F.lower("p_brand"), F.lower("p_type"))
    k = F.col("p_partkey") % 6
    noun = F.element_at(F.split("p_name", " "), -1)
    query = F.when(k == 0, F.col("p_name")).when(k == 1, both).when(k == 2, F.concat_ws(" ", "p_name", F.lower("p_type"))).when(k == 3, F.concat(F.lower("p_type"), F.lit(" engineering")))
    query = query.when(k == 4, F.concat(noun, F.lit(" systems"))).otherwise("data management")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    related = F.when((k == 5) & F.col("next").isNotNull(), F.array(F.struct(F.col("next").alias("skill_query"), F.lit("named next").alias("reason"), F.lit("llm_semantic").alias("source")))).otherwise(F.array().cast(RELATED))
    pick = F.col("p_size") % 3
    kind = F.element_at(F.array(*map(F.lit, ("technology", "capability", "soft_skill", "domain"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.join(after, "p_partkey", "left").select(
        F.concat(F.lit("job"), F.floor(F.col("p_partkey") / 25)).alias("job_id"), F.col("p_partkey").alias("seq"), F.concat_ws(" / ", "p_name", "p_brand", "p_type").alias("raw"), query.alias("skill_query"),
        F.when(pick == 0, "required").when(pick == 1, "preferred").otherwise("inferred").alias("importance"), kind.alias("category"), related.cast(RELATED).alias("related"),
    )


def star_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, person_id``: every person is held against one job, dealt round."""
    last = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0]
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select(F.concat(F.lit("job"), F.col("c_custkey") % ((last or 0) // 25 + 1)).alias("job_id"), F.col("c_custkey").cast("string").alias("person_id"))
