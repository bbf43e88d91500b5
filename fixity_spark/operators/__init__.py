"""DataFrame to DataFrame operators: joins, aggregations and windows over inventories and manifests."""
