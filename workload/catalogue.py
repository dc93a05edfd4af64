"""Imports every module that registers queries."""

from workload import aggregates, alerts, definitions, filters, findings, joins, quality, ranking, scalars, setops, sources, streams, text

MODULES = (sources, filters, joins, aggregates, ranking, findings, alerts, quality, text, definitions, scalars, setops, streams)
