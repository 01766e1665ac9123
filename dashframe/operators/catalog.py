"""Catalog operations over files, sheets, columns, visualizations, saved
analyses and sessions (J1-J5, U1-U5, R8-R11, W3, A18).

Tables are DataFrames; a change produces a new snapshot (write it to a new
path or table version) instead of mutating rows in place.  Lookups are joins
(semi/anti for existence), so they run as shuffled or broadcast joins chosen
by the optimizer from table statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dashframe.functions.columns import col
from dashframe.operators.order import page_per_group, top_per_group


def files_in_use(files: DataFrame, sheets: DataFrame, viz: DataFrame) -> DataFrame:
    """Files that some visualization reaches through a sheet."""
    used = sheets.join(viz.select("sheet_id"), "sheet_id", "left_semi")
    return files.join(used.select("file_id"), "file_id", "left_semi")


def orphan_files(files: DataFrame, sheets: DataFrame, viz: DataFrame) -> DataFrame:
    """J1 negated: files no visualization uses (safe to delete)."""
    used = sheets.join(viz.select("sheet_id"), "sheet_id", "left_semi")
    return files.join(used.select("file_id"), "file_id", "left_anti")


def dangling_visualizations(viz: DataFrame, sheets: DataFrame) -> DataFrame:
    """Visualizations whose sheet no longer exists."""
    return viz.join(sheets.select("sheet_id"), "sheet_id", "left_anti")


def file_tree(files: DataFrame, sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """File -> sheets -> columns as rows (one per sheet), with each
    sheet's column list.  Files without sheets keep one row with NULLs."""
    per_sheet = columns.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.concat_ws(",", F.sort_array(F.collect_list("column_name"))).alias("column_names"))
    return (files.select("file_id", "file_name")
            .join(sheets, "file_id", "left")
            .join(per_sheet, "sheet_id", "left")
            .select("file_id", "file_name", "sheet_id", "sheet_name",
                    F.coalesce("column_count", F.lit(0)).alias("column_count"),
                    "column_names"))


def file_documents(files: DataFrame, sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """J2 assembled: one row per file with its sheets and their columns (names
    and types) nested; a file or sheet without children has an empty list."""
    per_sheet = columns.groupBy("sheet_id").agg(F.sort_array(F.collect_list(
        F.struct("column_id", "column_name", "data_type"))).alias("columns"))
    no_columns = F.array().cast("array<struct<column_id:bigint,column_name:string,data_type:string>>")
    named = sheets.join(per_sheet, "sheet_id", "left").select(
        "file_id", F.struct("sheet_id", "sheet_name", F.coalesce("columns", no_columns).alias("columns"))
        .alias("sheet"))
    per_file = named.groupBy("file_id").agg(F.sort_array(F.collect_list("sheet")).alias("sheets"))
    out = files.join(per_file, "file_id", "left")
    kind = per_file.schema["sheets"].dataType
    return out.withColumn("sheets", F.coalesce("sheets", F.array().cast(kind)))


def dashboard_documents(viz: DataFrame) -> DataFrame:
    """J3 assembled: one row per dashboard with its visualizations nested, in
    order of creation."""
    return viz.groupBy("dashboard_id").agg(F.sort_array(F.collect_list(
        F.struct("created_at", "viz_id", "sheet_id", "viz_type"))).alias("visualizations"))


def save_files(files: DataFrame, sheets: DataFrame, columns: DataFrame, new_files: DataFrame,
               new_sheets: DataFrame, new_columns: DataFrame) -> dict[str, DataFrame]:
    """A batch of uploads saved with their sheets and columns.  A file that
    exists takes the new name, path and size and keeps its owner and upload
    time; an existing sheet takes the new name and stays in its file, an
    existing column takes the new name and type and stays in its sheet; what is
    new is added and nothing is removed."""
    return {"files": upsert(files, new_files, "file_id", keep_old=["user_id", "uploaded_at"]),
            "file_sheets": upsert(sheets, new_sheets, "sheet_id", keep_old=["file_id"]),
            "sheet_columns": upsert(columns, new_columns, "column_id", keep_old=["sheet_id"])}


def dashboard_visuals(viz: DataFrame) -> DataFrame:
    """Dashboard -> its visualizations, counted per type."""
    return viz.groupBy("dashboard_id", "viz_type").agg(F.count(F.lit(1)).alias("viz_count"))


def first_file(viz: DataFrame, sheets: DataFrame, files: DataFrame) -> DataFrame:
    """A dashboard's file is the file of its first visual (by creation
    time, then id); missing sheet or file gives NULLs."""
    first = top_per_group(viz, ["dashboard_id"], [F.col("created_at").asc(),
                                                  F.col("viz_id").asc()], 1).drop("rank")
    return (first.select("dashboard_id", "viz_id", "sheet_id")
            .join(sheets.select("sheet_id", "file_id"), "sheet_id", "left")
            .join(files.select("file_id", "file_name"), "file_id", "left")
            .select("dashboard_id", "viz_id", "sheet_id", "file_id", "file_name"))


def cascade_delete(files, sheets, columns, viz, doomed_files: DataFrame) -> dict:
    """Delete files and, down the hierarchy, their sheets and columns.
    Visualizations reference sheets without a cascade, so the ones that point
    at a removed sheet are returned as blockers."""
    doomed = doomed_files.select("file_id").distinct()
    gone_sheets = sheets.join(doomed, "file_id", "left_semi").select("sheet_id")
    return {
        "files": files.join(doomed, "file_id", "left_anti"),
        "file_sheets": sheets.join(doomed, "file_id", "left_anti"),
        "sheet_columns": columns.join(gone_sheets, "sheet_id", "left_anti"),
        "blocking_visualizations": viz.join(gone_sheets, "sheet_id", "left_semi"),
    }


def merge_missing(current: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Add the saved rows whose key is absent from the current ones."""
    return current.unionByName(saved.join(current.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: list[str] | None = None,
           keep_old: list[str] | None = None) -> DataFrame:
    """Insert-or-update by key.  Columns of ``keep_if_null`` keep the
    old value when the new one is NULL; ``keep_old`` columns are never
    updated (for example the owner); other columns take the new value."""
    kept = set(keep_if_null or []) | set(keep_old or [])
    # Rows that the batch doesn't touch pass by; only the batch is looked up,
    # and its side can be broadcast when it is small.
    untouched = old.join(new.select(key), key, "left_anti")
    before = old.select(key, *[col(c).alias(f"__{c}") for c in old.columns if c in kept])
    batch = new.join(before, key, "left")

    def value(c: str) -> Column:
        if c in set(keep_old or []):
            return F.coalesce(col(f"__{c}"), col(c))
        return F.coalesce(col(c), col(f"__{c}")) if c in kept else col(c)

    return untouched.unionByName(batch.select(*[value(c).alias(c) for c in old.columns]))


def delete_by_key_and_owner(table: DataFrame, requests: DataFrame, key: str,
                            owner: str) -> DataFrame:
    """U4: rows whose (key, owner) is requested are removed; a request with
    the right key but another owner removes nothing."""
    return table.join(requests.select(key, owner), [key, owner], "left_anti")


def unexpired(sessions: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows still valid at ``now``."""
    return sessions.where(col(expires) > now)


def latest_per_owner(sessions: DataFrame, now: Column, owner: str = "user_id",
                     activity: str = "last_activity", key: str = "session_id") -> DataFrame:
    """Each owner's live row with the newest activity."""
    live = unexpired(sessions, now)
    return top_per_group(live, [owner], [col(activity).desc(), col(key).desc()], 1).drop("rank")


def recent(table: DataFrame, owner: str, stamp: str, key: str, n: int = 8) -> DataFrame:
    """Each owner's newest n rows."""
    return top_per_group(table, [owner], [col(stamp).desc(), col(key).asc()], n)


def page_owner(table: DataFrame, owner: str, stamp: str, key: str, limit: int,
               offset: int = 0) -> DataFrame:
    """One page (limit/offset) of each owner's rows, newest first."""
    return page_per_group(table, [owner], [col(stamp).desc(), col(key).asc()], limit, offset)


def _like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_names(table: DataFrame, column: str, query: str) -> DataFrame:
    """Case-insensitive substring match; ``%`` and ``_`` in the query
    are literal."""
    return table.where(col(column).ilike(f"%{_like_escape(query)}%"))


def lookup_ci(table: DataFrame, column: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """Rows whose column equals one of the wanted values ignoring case."""
    keys = wanted.select(F.lower(col(wanted_col)).alias("__k")).distinct()
    return (table.withColumn("__k", F.lower(col(column)))
            .join(keys, "__k", "left_semi").drop("__k"))


def count_per_owner(table: DataFrame, owner: str) -> DataFrame:
    """Rows per owner, with the table total on every row."""
    per = table.groupBy(col(owner)).agg(F.count(F.lit(1)).alias("row_count"))
    total = table.agg(F.count(F.lit(1))).scalar()
    return per.withColumn("total_rows", total)


def cascade_delete_users(files, sheets, columns, viz, doomed_users: DataFrame,
                         owner: str = "user_id", dashboard_owner: str = "dashboard_id") -> dict:
    """J5 from the top: removing users removes their files (and, down the
    chain, sheets and columns) and their dashboards' visualizations.  A
    surviving visualization that points at a removed sheet blocks the delete
    (that reference has no cascade) and is returned as a blocker."""
    users = doomed_users.select(F.col(owner).alias("__u")).distinct()
    doomed_files = files.join(users, files[owner] == users["__u"], "left_semi")
    by_file = cascade_delete(files, sheets, columns, viz, doomed_files)
    gone_sheets = sheets.join(doomed_files.select("file_id"), "file_id", "left_semi") \
        .select("sheet_id")
    kept_viz = viz.join(users, viz[dashboard_owner] == users["__u"], "left_anti")
    return {
        "files": by_file["files"],
        "file_sheets": by_file["file_sheets"],
        "sheet_columns": by_file["sheet_columns"],
        "visualizations": kept_viz,
        "blocking_visualizations": kept_viz.join(gone_sheets, "sheet_id", "left_semi"),
    }
