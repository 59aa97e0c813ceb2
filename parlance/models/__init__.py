"""The boundary to models: interfaces, registries, batched calls and scripted doubles for tests."""
