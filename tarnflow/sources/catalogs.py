"""Session options of catalogs."""

from __future__ import annotations


def catalog_options(kind: str, name: str, **options: str) -> dict[str, str]:
    """``spark.sql.catalog.<name>`` options of a catalog.

    Kinds: ``paimon`` (warehouse, metastore, s3 settings), ``iceberg`` (catalog_type, uri,
    warehouse), ``hive`` (conf_dir), ``jdbc`` (url, driver), and ``generic`` (implementation and anything
    else). Their jars have to be on the class path; none is here, so these are untried.
    """
    base = f"spark.sql.catalog.{name}"
    made = {
        "paimon": "org.apache.paimon.spark.SparkCatalog",
        "iceberg": "org.apache.iceberg.spark.SparkCatalog",
        "jdbc": "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog",
    }
    if kind == "hive":
        return {"spark.sql.catalogImplementation": "hive", "spark.hadoop.hive.conf.dir": options.get("conf_dir", "")}
    if kind == "generic":
        options = dict(options)
        return {base: options.pop("implementation")} | {f"{base}.{k}": str(v) for k, v in options.items()}
    if kind not in made:
        raise ValueError(f"no such catalog: {kind}")
    renamed = {"catalog_type": "type"}
    return {base: made[kind]} | {f"{base}.{renamed.get(k, k.replace('_', '-') if k.startswith('s3') else k)}": str(v) for k, v in options.items()}
