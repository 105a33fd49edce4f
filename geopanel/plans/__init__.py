"""Logical plans: formulas to columns, raw tables to validated panels."""
