"""Plans of several steps: tables in the shared folder, ranks, clustered layouts."""
