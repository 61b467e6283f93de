"""Registered queries of the splat engine and the SQL that checks them."""
