"""keyloom: static minimal-perfect-hash indexes and keyed lookups as Spark DataFrame plans."""
