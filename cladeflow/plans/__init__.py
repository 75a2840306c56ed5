"""Named queries over the given tables, with equivalent SQL where there is one."""
