"""SQL scripts and the registered check queries."""
