"""DataFrame operators: tables, partitions, jobs, lists, map/reduce."""
