"""tidemark: run-history analytics for Apache Spark.

The caller brings the history of a workflow platform (runs, steps, events,
approvals, costs, definitions) as DataFrames and gets DataFrames back.  Every
operator covers all tenants in one job, takes its reference time as a parameter
and leaves the physical plan to Catalyst.
"""
