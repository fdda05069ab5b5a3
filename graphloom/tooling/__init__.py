"""Project tools: configuration, checking, TypeScript output and watching. They run on the driver alone."""
