"""Registered queries over the given tables, each with the SQL that must agree with it."""

from checks import context_checks, plan_checks, request_checks, search_checks, stats_checks, store_checks, sync_checks, text_checks

MODULES = [sync_checks, text_checks, request_checks, search_checks, context_checks, stats_checks, store_checks, plan_checks]
